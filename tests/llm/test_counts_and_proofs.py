"""Token counts, hard negatives and manifests against the library and brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmill.llm import hard_negatives, merkle, token_counts
from promptmill.llm.queries import tokenizer_file

WORDS = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(open(WORDS, encoding="utf-8").read())


def library(counter, text):
    return len(counter.tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_white_space_ends_pieces(counter):
    """What Python's split takes for white space, but for the four separators, the tokenizer drops."""
    for c in filter(str.isspace, map(chr, range(0x110000))):
        text = f"zq{c}bx {c}{c}y{c}"
        assert counter.counts([text]) == [library(counter, text)], hex(ord(c))


PARTS = ["a", "the", "ing", "'", "s", "'re", "'s", " ", "\n", "\x1c", "\x85", "　", "日本", "é", "é", "́", "İ", "Σ", "|", "<|endoftext|>", "<|", "text|>", "!", "...", "1", "²", "ß", "😀", "‍", "각", "ᆨ"]


def texts(rng):
    for _ in range(60):
        yield "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300)))
    for letters in ("abcdefghijklmnopqrstuvwxyz", "éАБ日a", "!.-_=#*", "a"):
        for n in (70, 400, 1500):
            yield "".join(rng.choice(letters) for _ in range(n))
    yield "startoftext" * 90
    yield "́" * 700  # no proven boundary: widened up to the whole text
    yield "ab́" * 300


def test_counts_equal_the_library(spark, docs_of, counter):
    rng = random.Random(3)
    rows = [*enumerate([None, "", " ", "\n\n", *texts(rng)]), (0, None), (5, "again and again " * 40), (5, "again and again " * 40)]
    docs = docs_of(rows)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(docs, WORDS, ["doc_id"], limit=50, chunk=128, overlap=48).collect())
    assert got == sorted((i, len((t or "").encode()), n := library(counter, t), n > 50) for i, t in rows)
    plain = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(docs, WORDS, ["doc_id"], limit=50).collect())
    assert plain == got
    assert token_counts.count(docs.limit(0), WORDS, ["doc_id"]).collect() == []


def test_seams_are_proven_in_words_and_in_runs(counter):
    for text in ("some words, and others " * 40, "antidisestablishmentarianism" * 30, "-=" * 400, "日本語の文章" * 80):
        left, right = text[:400], text[336:]
        overlap = text[336:400]
        excess = token_counts.splice(overlap, counter.near(left, 336, 400), counter.near(right, 0, 64))
        if excess is not None:
            assert sum(counter.counts([left, right])) - excess == library(counter, text)
        assert (excess is None) == ("の" in overlap), text[:20]  # kana are not among the letters of the proof


def test_other_tokenizers_get_whole_texts(spark, docs_of):
    path = tokenizer_file("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer, text = Tokenizer.from_file(path), "Some text, <|endoftext|> and more  \n" * 30
    assert not token_counts.provable(__import__("json").load(open(path)))
    got = token_counts.count(docs_of([(1, text)]), path, ["doc_id"], chunk=100, overlap=40).first()
    assert got.n_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)


# --- hard negatives


def brute_negatives(rows, anchors, k=5, low=80, high=100):
    rows = {i: (lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows}
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1], strict=True))
    out = []
    for a in sorted(i for i in rows if i in anchors):
        others = sorted((-score(a, b), b) for b in rows if b != a and len(rows[b][1]) == len(rows[a][1]))
        same = [(s, b) for s, b in others if rows[b][0] == rows[a][0]][:k]
        for p, positive in same:
            fits = [(s, b) for s, b in others if rows[b][0] != rows[a][0] and low * -p <= 100 * -s <= high * -p][:k]
            out += [(a, positive, n, b, -p, -s) for n, (s, b) in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, rows):
    made = [(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x", 1) for i, v, lab in rows]
    return spark.createDataFrame(made, "vec_id bigint, embedding array<float>, label int, tile string, score int").repartition(3)


def mined(spark, rows, monkeypatch, tile=64, block=8):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    found = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(v), int(lab)) for i, (v, lab) in enumerate(zip(rng.normal(size=(300, 6)) / 4, rng.integers(0, 4, 300), strict=True))]
    assert mined(spark, rows, monkeypatch) == brute_negatives(rows, set(range(0, 300, 10)))


def test_negatives_with_ties_and_a_hot_vector(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-1, 2, 3) / 4, int(rng.integers(0, 3))) for i in range(200)]
    rows += [(200 + i, [0.25, 0.25, 0.25], i % 2) for i in range(120)]
    rows += [(400, [0.5, 0.5], 1), (410, [0.25, 0.25], 1), (401, [0.25, 0.2], 0), (420, [], 1), (421, [], 0), (422, [], 1)]
    want = brute_negatives(rows, {i for i, _, _ in rows if i % 10 == 0})
    bad = [(None, [1.0, 1.0, 1.0], 1), (500, None, 1), (510, [1.0, None, 1.0], 1), (520, [1.0, float("nan"), 1.0], 1), (530, [1.0, float("inf"), 0.0], 0), (540, [1.0, 1.0, 1.0], None)]
    assert mined(spark, [*rows, *bad, *rows[:40]], monkeypatch) == want  # repeated rows count once
    assert mined(spark, [], monkeypatch) == [] and mined(spark, [(0, [1.0], 1)], monkeypatch) == []


def test_far_tiles_are_not_visited():
    """Clusters by themselves: a search opens few of the leaves."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-200, 201, (16, 16))
    v = np.concatenate([c + rng.integers(-3, 4, (256, 16)) for c in centres])
    label = np.zeros(len(v), np.int64)
    asked = hard_negatives.Asked(np.array([0]), label[:1], v[:1], np.array([hard_negatives.LOWEST]), np.array([hard_negatives.HIGHEST]), np.array([hard_negatives.LOWEST]))
    order, start, boxes = hard_negatives.packed(label, v)
    _, found, score = hard_negatives.search(np.arange(len(v)), label, v, asked, True)
    _, most = boxes.reach(v[:1])
    assert (most[0] >= score.min()).sum() < len(start) / 3
    want = sorted((-int(v[0] @ v[i]), i) for i in range(1, len(v)))[:5]
    assert sorted(zip((-score).tolist(), found.tolist(), strict=True)) == want


def test_large_components_are_an_error(spark):
    rows = vectors(spark, [(0, [1e30], 1), (1, [1.0], 1)])
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives.mine(rows, F.col("vec_id") % 10 == 0).collect()


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(*(value(x) for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i: i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute_manifest(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]))):
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf_of(r, r["text"]) for r in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for place, r in enumerate(groups[s]):
            leaf = leaf_of(r, r["text"])
            odd = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2
            fold = leaf if odd else leaf_of(r, None if r["text"] is None else r["text"].replace("\n", ""))
            proof = []
            for tree, at in ((trees[s], place), (top, names.index(s))):
                for nodes in tree[:-1]:
                    run = nodes[at // 3 * 3: at // 3 * 3 + 3]
                    proof += run[: at % 3] + run[at % 3 + 1:]
                    fold = h(*run[: at % 3], fold, *run[at % 3 + 1:])
                    at //= 3
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], h(*proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_levels", [1, 2, 6])
def test_manifest_equals_brute_force(spark, block_levels):
    rng = random.Random(7)
    kinds = [None, "", "a", "B", "é", "hot", "hot", "hot", "one"]
    rows = [{"doc_id": i, "source": rng.choice(kinds[:-1]), "lang": rng.choice([None, "en"]), "n_chars": rng.choice([None, 5]), "text": rng.choice([None, "", "a\nb", "\n", f"line {i}\nmore", "plain"])} for i in range(130)]
    rows += [dict(rows[3]), dict(rows[3]), {"doc_id": None, "source": "hot", "lang": None, "n_chars": None, "text": "x\ny"}, {"doc_id": 900, "source": "one", "lang": "de", "n_chars": 1, "text": "é\n"}]
    made = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "clash", 1) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, _at int").repartition(4)
    run = lambda df: merkle.manifest(
        df, ["doc_id", "source", "lang", "n_chars", "text"], merkle.even_checksum(), {"text": F.replace("text", F.lit("\n"), F.lit(""))}, block_levels=block_levels)
    assert sorted((tuple(r) for r in run(made).collect()), key=repr) == brute_manifest(rows)
    assert run(made.limit(0)).collect() == []
    only = made.where("doc_id = 900")
    assert sorted((tuple(r) for r in run(only).collect()), key=repr) == brute_manifest([rows[-1]])


def test_versions_share_nodes():
    leaves = [h(str(i)) for i in range(27)]
    tree = merkle.Tree(leaves, 3)
    before = (list(tree.digest), tree.root)
    root = tree.replace(tree.root, 13, h("x"))
    assert len(tree.digest) - len(before[0]) == 4 and tree.digest[: len(before[0])] == before[0]
    assert tree.digest[root] == levels([*leaves[:13], h("x"), *leaves[14:]])[-1][0] and tree.digest[before[1]] == levels(leaves)[-1][0]
