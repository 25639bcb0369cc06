"""Language, near copies, repeated strings, benchmark passages: against brute force on small texts."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from promptmill.llm import components, decontaminate, jaccard, language_id, suffix_dedup

WORDS = [a + b + c for a in ("ba", "ke", "so", "ti", "mu") for b in ("l", "rn", "st", "x") for c in ("a", "ed", "ing", "or", "um", "y")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- language ----------------------------------------------------------------------

ALPHABETS = {"aa": "abcde", "bb": "fghij", "cc": "klmé"}


def texts_in(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language(spark, docs_of):
    rng = random.Random(1)
    langs = {i: sorted(ALPHABETS)[i % 3] for i in range(60)}
    rows = [(i, texts_in(rng, langs[i], 40)) for i in range(60)]
    langs[59] = None
    model = language_id.learn(docs_of(rows, langs))
    assert model.languages == ["aa", "bb", "cc"]
    odd = [(100, None), (101, ""), (102, "123 !? \n"), (103, "zzz ŵŵŵ"), (104, rows[0][1]), (104, rows[0][1]), (None, rows[1][1]), (105, rows[2][1] * 400)]
    got = language_id.identify(docs_of(rows + odd, langs), model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) + len(odd)
    by_text = {r.text: (r.lang_pred, r.score) for r in got}
    assert all(by_text[t][0] == sorted(ALPHABETS)[i % 3] and 0.5 < by_text[t][1] <= 1 for i, t in rows)
    assert by_text[None] == by_text[""] == by_text["123 !? \n"] == ("und", 0.0)
    assert by_text["zzz ŵŵŵ"] == ("aa", 0.0)
    assert by_text[rows[2][1] * 400][0] == "cc"


def test_language_counts_equal_brute_force():
    texts = ["Ab, c! d", "", "x", "ÀB cd"]
    gram, first, has_letter = language_id.trigrams(texts)
    want = []
    for t in texts:
        s = re.sub(r"[^a-zà]+", " ", f" {t.lower()} ")
        s = " " + s.strip() + " " if s.strip() else " "
        want.append([s[i: i + 3] for i in range(len(s) - 2)])
    got = ["".join(chr((int(g) >> k) & 0x1FFFFF) for k in (42, 21, 0)) for g in gram]
    assert [got[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == want
    assert has_letter.tolist() == [True, False, True, True]


def test_many_languages_share_a_sliced_filter(docs_of):
    rng = random.Random(5)
    names = [f"l{i:03}" for i in range(70)]  # more than one table word
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(words[n] * 3)) for i, n in enumerate(names)]
    langs = dict(enumerate(names))
    model = language_id.learn(docs_of(rows, langs))
    assert model.table.shape[0] == 2
    assert language_id.judge(model, [t for _, t in rows])[0] == names


def test_language_without_labels(spark, docs_of):
    rows = [(1, "abc"), (2, None)]
    model = language_id.learn(docs_of(rows, {}))
    got = language_id.identify(docs_of(rows), model, ["doc_id"]).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert language_id.identify(docs_of([]), model, ["doc_id"]).count() == 0


# ---- near copies ------------------------------------------------------------------

def shingles(text, n=5):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return frozenset(tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_links(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both >= similarity * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for i in range(len(rows)):
        least[root(i)].append(rows[i][0])
    return sorted((str(rows[i][0]), str(min((x for x in least[root(i)] if x is not None), default=None)), links[i]) for i in range(len(rows)))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(2)
    base = [prose(rng, 60).split() for _ in range(6)]
    rows = []
    for i in range(130):
        w = list(base[i % 3 if i < 90 else i % 6])
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, "one two"), (203, "One, two!"), (204, "!!"), (205, prose(rng, 30_000)), (206, rows[0][1]), (206, rows[0][1])]


@pytest.mark.parametrize("block", [512, 16])
def test_near_copies(docs_of, copies, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.join(docs_of(copies)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_links(copies)


def test_near_copies_of_nothing(docs_of):
    assert jaccard.join(docs_of([])).count() == 0
    got = jaccard.join(docs_of([(None, "a b c d e f"), (None, "a b c d e f"), (3, None)])).collect()
    assert sorted((str(r.doc_id), r.n_links, r.n_copies) for r in got) == [("3", 0, 1), ("None", 1, 2), ("None", 1, 2)]


@pytest.mark.parametrize("similarity, recall", [(0.8, 0.9999), (0.9, 0.999), (0.5, 0.95)])
def test_bands_reach_the_recall(similarity, recall):
    bands, rows = jaccard.choose_bands(similarity, recall)
    assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= jaccard.MAX_HASHES
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.2, 0.9999, 8)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(500, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {x: root(x) for x in list(parent)} and len(got) == len(parent)


# ---- repeated strings ---------------------------------------------------------------

def brute_removed(rows, length):
    key = lambda i: -(1 << 63) if i is None else i
    first = {}  # smallest id that has a string
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, b in coded:
        for k in range(len(b) - length + 1):
            w = b[k: k + length]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, b in coded:
        gone, here = bytearray(len(b)), set()
        for k in range(len(b) - length + 1):
            w = b[k: k + length]
            if first[w] < key(i) or w in here:
                gone[k: k + length] = b"\1" * length
            here.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, hot", [(100, 20_000), (100, 1), (40, 20_000), (33, 3)])
def test_repeated_strings(docs_of, length, hot, monkeypatch):
    rng = random.Random(4)
    blocks = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(30, 260))) for _ in range(10)]
    rows = [(i, "".join(rng.choice(blocks)[rng.randint(0, 20):] for _ in range(rng.randint(1, 6)))) for i in range(8, 60)]
    rows += [(1, "a" * 350), (2, "ab" * 200), (3, "x" + "ab" * 90 + "y"), (4, ""), (5, None), (6, "a" * 99), (7, "a" * 100 + "é" * 120), (7, "é" * 130 + "q"),
             (61, rows[0][1]), (61, rows[0][1]), (None, rows[1][1]), (62, prose(rng, 4000))]
    monkeypatch.setattr(suffix_dedup.spans, "__defaults__", (length, hot))
    got = suffix_dedup.remove(docs_of(rows), length=length).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removed(rows, length)


def test_repeated_strings_of_nothing(docs_of):
    assert suffix_dedup.remove(docs_of([])).count() == 0
    assert suffix_dedup.rewrite(docs_of([(1, None)])).first().kept_text == ""


# ---- benchmark passages ---------------------------------------------------------------

def test_decontamination(spark, docs_of):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(15, 57)).capitalize() + ".") for i in range(70)]
    rows, planted = [], set()
    for i in range(300):
        text = prose(rng, rng.randint(5, 400)).split()
        if i % 3 == 0:
            k = rng.randrange(70)
            own = items[k][1].split()
            if i % 2:
                for _ in range(len(own) // 8):  # a paraphrase: other words here and there
                    own[rng.randrange(len(own))] = rng.choice(WORDS)
            at = rng.randrange(len(text))
            text[at:at] = own
            planted.add((i, k))
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "x"), (None, items[3][1]), (903, "y " * 30_000 + items[5][1])]
    bench = spark.createDataFrame(items + [(71, None), (72, ""), (73, items[0][1])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs_of(rows), bench, ["doc_id"]).collect()}
    words = {i: decontaminate._words(t) for i, t in rows}
    assert planted <= set(got) and (None, 3) in got and (903, 5) in got
    for (d, k), r in got.items():  # and nothing that does not hold the item
        if k != 73:
            own = decontaminate._words(items[k][1])
            around = words[d][r.first_word: r.first_word + 2 * decontaminate.STEP + 2 * len(own)]
            assert decontaminate.common_words(own, around) >= 0.5 * len(own) and r.common >= 0.5
    clean = decontaminate.without(docs_of(rows), bench)
    assert clean.columns == docs_of(rows).columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in {d for d, _ in got})
    assert decontaminate.find(docs_of([]), bench, ["doc_id"]).count() == 0
    assert decontaminate.find(docs_of(rows), bench.where("false"), ["doc_id"]).count() == 0


def test_answers_admit_looser_copies(spark, docs_of):
    rng = random.Random(8)
    filler = [(i, prose(rng, 200)) for i in range(40)]
    own = prose(rng, 30).split()
    own = [f"{w}q{i}" for i, w in enumerate(own)]
    loose = own[::2] + own[-4:]
    rows = [*filler, (100, prose(rng, 30) + " " + " ".join(loose) + " " + prose(rng, 30))]
    bench = spark.createDataFrame([(1, " ".join(own), " ".join(own[-4:])), (2, " ".join(own), "other words")], "item_id bigint, text string, answer string")
    got = decontaminate.find(docs_of(rows), bench, ["doc_id"], answer="answer").collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(100, 1)]


def test_decontamination_finds_all_that_meets_its_rule(spark, docs_of):
    """Copies that lost their rarest words, and short items of common words, against every passage compared by brute force."""
    rng = random.Random(12)
    rare = [f"zq{i}" for i in range(4000)]

    def item(n):  # a third of its words are rare
        return [rng.choice(rare) if j % 3 == 0 else rng.choice(WORDS) for j in range(n)]

    items = [item(rng.randint(20, 50)) for _ in range(16)] + [prose(rng, n).split() for n in range(4, 11)] + [["alone"]]
    answers = [None if i % 2 else " ".join(own[1:3]) for i, own in enumerate(items)]
    rows = [(i, prose(rng, rng.randint(1, 90))) for i in range(60)]
    for i, own in enumerate(items):
        for share in (0.7, 0.5):
            copy = list(own)
            lost = [j for j in range(len(own)) if not (share == 0.5 and j in (1, 2))]
            lost.sort(key=lambda j: own[j] in WORDS)  # rare words go first
            for j in lost[: int(len(own) * (1 - share))]:
                copy[j] = rng.choice(rare)
            text = [rng.choice(rare) for _ in range(60)]
            at = rng.randrange(60)
            rows.append((len(rows), " ".join(text[:at] + copy + text[at:])))
    want = set()
    for i, own in enumerate(items):
        mine, answer = decontaminate._words(" ".join(own)), decontaminate._words(answers[i])
        for d, text in rows:
            words = decontaminate._words(text)
            for at in range(0, len(words), decontaminate.STEP):
                around = words[max(0, at - len(mine)): at + 2 * decontaminate.STEP + len(mine)]
                share = decontaminate.common_words(mine, around) / len(mine)
                if share >= 0.7 or (share >= 0.5 and decontaminate._within(answer, around)):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(own), answers[i] or "") for i, own in enumerate(items)], "item_id int, text string, answer string")
    docs = docs_of(rows)
    got = decontaminate.find(docs, bench, ["doc_id"], answer="answer", exact=True).select("doc_id", "item_id").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert {r.doc_id for r in decontaminate.without(docs, bench, answer="answer", exact=True).select("doc_id").collect()} == {d for d, _ in rows} - {d for d, _ in want}
    near = [tuple(r) for r in decontaminate.find(docs, bench, ["doc_id"], answer="answer").select("doc_id", "item_id").collect()]
    assert len(near) == len(set(near)) and set(near) <= want and len(near) >= 0.9 * len(want)


def test_the_latent_space_brings_copies_and_paraphrases_near(spark, docs_of, monkeypatch):
    """More items than dimensions, several spaces: 70 % of the words, or half of them and the answer, the rarest lost first."""
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in WORDS for b in ("", "ra", "lo", "mi", "tes", "qua")]

    def some(n):
        return [vocabulary[min(int(rng.paretovariate(0.6)) - 1, 10**6) % len(vocabulary)] for _ in range(n)]

    items = [some(rng.randint(15, 50)) for _ in range(150)] + [some(n) for n in range(4, 15)]
    answers = ["" if i % 2 else " ".join(own[-3:]) for i, own in enumerate(items)]
    rows = [(i, " ".join(some(rng.randint(1, 300)))) for i in range(100)]
    for i, own in enumerate(items):
        for share in (1.0, 0.7, 0.5):
            copy, lost = list(own), list(range(len(own) - 3))
            lost.sort(key=lambda j: -vocabulary.index(own[j]))
            for j in lost[: int(len(own) * (1 - share))]:
                copy[j] = some(1)[0]
            around = some(80)
            at = rng.randrange(80)
            rows.append((len(rows), " ".join(around[:at] + copy + around[at:])))
    monkeypatch.setattr(decontaminate, "ITEMS", 128)
    bench = spark.createDataFrame([(i, " ".join(own), answers[i]) for i, own in enumerate(items)], "item_id int, text string, answer string")
    docs = docs_of(rows)
    whole, near = ({tuple(r) for r in decontaminate.find(docs, bench, ["doc_id"], answer="answer", exact=e).select("doc_id", "item_id").collect()} for e in (True, False))
    assert {(100 + 3 * i, i) for i in range(len(items))} <= whole  # the copies
    assert near <= whole and len(near) >= 0.9 * len(whole)
    monkeypatch.setattr(decontaminate, "latent_space", lambda docs, bench: np.zeros((len(bench.entry_block), decontaminate.RANK)))
    assert not decontaminate.find(docs, bench, ["doc_id"], answer="answer").count()  # nothing comes another way


def test_a_space_is_fitted_to_a_bounded_sample_and_searched_for_everywhere(spark, docs_of, monkeypatch):
    rng = random.Random(22)
    items = [(i, prose(rng, 40)) for i in range(20)]
    rows = [(i, prose(rng, 60) + " " + items[i % 20][1] + " " + prose(rng, 60)) for i in range(200)]
    monkeypatch.setattr(decontaminate, "SAMPLE", 300)  # of 1600 blocks
    got = {tuple(r) for r in decontaminate.find(docs_of(rows), spark.createDataFrame(items, "item_id int, text string"), ["doc_id"]).select("doc_id", "item_id").collect()}
    assert {(i, i % 20) for i in range(200)} <= got


def test_common_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(0, 15))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_words(a, b) == table[-1, -1]
