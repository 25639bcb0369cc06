"""URL filters, archives, token files, search, BPE, licences, the pipeline: literal cases, round trips, brute force."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from check_oracle import compare, connect
from promptmill.llm import bpe, license_scan, pretokens, queries, token_files, url_filter, vptree, warc

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n", "it's  Tom's\n\n 's 'sta ''s 12²٣ é", "a" * 300, "<|endoftext|> x", "日本 語👍", " \t\r\n x", "the the the"]


# ---- url filters ------------------------------------------------------------------------

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "a.b.com", ""), ("allow", "b.com", "/x"),
         ("block", "com", "/fr/deep/"), ("block", "", "/root"), ("allow", None, "/"), ("block", "EXAMPLE.net", "/q")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h.lower() + p, v) for v, h, p in RULES if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


@pytest.mark.parametrize("rows", [50_000, 3])
def test_url_filter(spark, rows, monkeypatch):
    monkeypatch.setattr(url_filter, "ROWS_PER_SWEEP", rows)
    rng = random.Random(1)
    hosts = ["org", "example.org", "www.EXAMPLE.org", "xexample.org", "a.b.com", "z.a.b.com", "b.com", "com", "c.com", "", "example.net", "org.", ".org", "a..com"]
    urls = [None, "", "nothing", "http://", "x://org", "http://org?x=/es/", "HTTP://ORG/é#/a", "a://b://com/fr/"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/12?a', '/fr/', '/fr/deep/1', '/x', '/q', '/root', '/de/#x'])}" for _ in range(150)]
    pages = spark.createDataFrame([(i // 2 if i > 4 else None, u, "extra") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, RULES)).collect()
    want = sorted((str(i // 2 if i > 4 else None), *map(str, brute_url(u))) for i, u in enumerate(urls))
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == want
    assert url_filter.judge(pages.where("false"), url_filter.rule_table(spark, RULES)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark, []), default="block").collect()} == {"block"}


# ---- archives -------------------------------------------------------------------------

def test_files_of_pages_without_urls_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "FILE_LIMIT", 40_000)
    rows = [(i, None, "y" * (9_000 if i % 5 else 0) or None) for i in range(40)]
    warc.write(spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(1), f"{tmp_path}/w")
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) <= 40_000
    assert {r.record_id for r in warc.read(spark, f"{tmp_path}/w").collect()} == {f"<urn:x-page:{i}>" for i in range(40)}


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>" + "x" * 1200
    rows = [(1, "http://a/\r\n b", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long),
            (7, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20), (8, "u", "y" * 2_000_000), (9, "u", "z" * 999), (10, "u", "z" * 999)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    warc.write(pages, f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    by_id = {r.record_id: r for r in got}
    for i, _, html in rows:
        r = by_id[f"<urn:x-page:{'' if i is None else i}>"]
        raw = (html or "").encode()
        again = html == long and i != 2
        assert (r.record_type, r.payload_bytes, r.payload_digest) == ("revisit" if again else "response", len(raw), hashlib.sha1(raw).hexdigest())
        assert r.refers_to == ("<urn:x-page:2>" if again else None) and bytes(r.payload) == (b"" if again else raw)
    warc.write(pages.where("false"), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


def record(body, kind="response", more=""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_salvage():
    a, b, c = record(b"one"), record(b"two" * 50), record(b"three")
    bad_length = b.replace(b"Content-Length: ", b"Content-Length: 9")
    bad_digest = b.replace(b"twotwo", b"twOtwo", 1)
    for middle, reason in ((b"garbage" * 3, "no version line"), (bad_length, "record does not end"), (bad_digest, "payload digest differs"), (b[:40], ""), (b"WARC/1.1\r\nx\r\n\r\n", "without a colon")):
        found = list(warc.salvage(a + middle + c))
        assert [x.payload for x in found if isinstance(x, warc.Record)] == [b"one", b"three"]
        gap, = [x for x in found if isinstance(x, warc.Gap)]
        assert (gap.start, gap.end) == (len(a), len(a + middle)) and reason in gap.reason
    za, zb, zc = gzip.compress(a), bytearray(gzip.compress(b)), gzip.compress(c + a)
    zb[len(zb) // 2] ^= 0xFF
    found = list(warc.salvage(za + bytes(zb) + zc + c))
    assert [x.payload for x in found if isinstance(x, warc.Record)] == [b"one", b"three", b"one", b"three"]
    assert [(x.start, x.end) for x in found if isinstance(x, warc.Gap)] == [(len(za), len(za) + len(zb))]
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(a[:-6])] == [warc.Gap]
    everything = list(warc.salvage(a * 3 + b"\0" * 5))
    assert sum(x.end - x.start for x in everything) == len(a * 3) + 5  # every byte is in a record or in a gap


# ---- token files ------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32 - 1])
def test_packed_blocks(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = np.uint32(min(high * 7, 2**32 - 1))
    payload, starts = token_files.pack(ids)
    assert (token_files.unpack(payload, starts, n) == ids).all()
    if len(starts) > 2:  # any run of blocks by itself
        assert (token_files.unpack(payload, starts[1:2], 256) == ids[256:512]).all()


def test_token_files(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "word " * 3000), (51, "other"), (None, "first")] + [(100 + i, " ".join(rng.choice("abc de fgh ij's".split()) for _ in range(60))) for i in range(30)]
    path = P.path("byte_bpe_50k.json")
    token_files.write(docs_of(rows), f"{tmp_path}/t", path, end_id=2)
    library = Tokenizer.from_file(path)
    start, want = 0, []
    places = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_files.checksums(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in places]
    coded = {(i, zlib.crc32(np.array(ids, "<u4").tobytes())): len(ids) for i, t in rows for ids in [library.encode(t or "", add_special_tokens=False).ids + [2]]}
    for r in got:
        assert r.start == start and coded[r.doc_id, r.ids_crc32] == r.n_tokens
        start += r.n_tokens
    ids = {(r.doc_id, len(r.ids)): list(r.ids) for r in token_files.read(spark, f"{tmp_path}/t").collect()}
    assert ids[3, len(library.encode(ODD[3]).ids) + 1] == [*library.encode(ODD[3]).ids, 2]
    token_files.write(docs_of([]), f"{tmp_path}/none", path)
    assert token_files.checksums(spark, f"{tmp_path}/none").count() == 0


# ---- byte-pair encoding -------------------------------------------------------------------

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_cut_points_are_those_of_the_pattern():
    import regex

    rng = random.Random(1)
    parts = ["a", "b", "'", "s", "t", "l", "re", "ve", " ", "  ", "\n", "\t", "é", "日", "1", "²", "!", "?", "\x1c", "\u0301", "👍", "d", "m", "S", "ll", "\r\n", "٣", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    chars, offsets = pretokens.code_points(texts)
    start = pretokens.cut_points(chars, offsets).tolist()
    joined = "".join(texts)
    assert [joined[a:b] for a, b in zip(start, [*start[1:], len(joined)], strict=True)] == [p for t in texts for p in regex.findall(P.PATTERN, t)]


@pytest.mark.parametrize("states", [bpe.MAX_STATES, 50])
def test_transducer(states):
    machine = bpe.Transducer(RANKS, states)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abcdeghinorstu é") for _ in range(rng.randint(1, 40))).encode() for _ in range(2000)] + [bytes(rng.randrange(256) for _ in range(9)) for _ in range(500)]
    assert all(machine.encode(p) == ENCODING._encode_single_piece(p) for p in pieces)
    assert len(machine.states) <= states + 50


def test_transducer_of_a_small_vocabulary_with_unreachable_tokens():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260, b"xyz": 261}
    encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    machine = bpe.Transducer(ranks)
    rng = random.Random(5)
    for p in ["xyz", "xyzx", *("".join(rng.choice("abcdxyz") for _ in range(rng.randint(1, 12))) for _ in range(1500))]:
        assert machine.encode(p.encode()) == encoding.encode_ordinary(p)


def test_pieces_never_met_are_read_side_by_side(monkeypatch):
    alone, move = [], bpe.Transducer._move
    monkeypatch.setattr(bpe.Transducer, "_move", lambda self, *step: alone.append(step) or move(self, *step))
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdeghinorstué") for _ in range(12)) for _ in range(3000))
    ids, first = bpe.encoded([text, "", text[:50]], bpe.Transducer(RANKS), {})
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [ENCODING.encode_ordinary(t) for t in (text, "", text[:50])]
    assert len(alone) < 300  # transitions built one at a time; some 20,000 are new


@pytest.mark.parametrize(("window", "few", "states", "block"), [(4096, 1, 120_000, 1 << 18), (16, 5, 200, 3000), (1, 1, 100, 1000), (7, 10**9, 100, 1 << 18)])
def test_long_pieces_are_held_back_by_the_window_only(monkeypatch, window, few, states, block):
    for name, value in (("WINDOW", window), ("FEW", few), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(8)
    pieces = ["".join(rng.choice("etaoin shrdlué") for _ in range(rng.randint(1, 300))).encode() for _ in range(80)] + [b"a" * 300, b" " * 700, b"ab" * 4000, b"", b"\xff", b" the"]
    rng.shuffle(pieces)
    got = bpe.Transducer(RANKS, states, 500).encode_all(pieces)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ENCODING._encode_single_piece(p) if p else [] for p in pieces]


def test_round_trip(docs_of):
    rows = [*enumerate(ODD), (50, None), (51, "word\u2028é" * 9000), (51, "other"), (None, "x")]
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs_of(rows), P.path("byte_bpe_50k.tiktoken"), ["doc_id"], chunk=3).collect())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    coded = [(i, ENCODING.encode_ordinary(t or ""), t or "") for i, t in rows]
    assert got == sorted((str(i), len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.encode())) for i, ids, t in coded)
    ids = bpe.encode(docs_of(rows), P.path("byte_bpe_50k.tiktoken"), ["doc_id"])
    back = bpe.decode(ids, P.path("byte_bpe_50k.tiktoken"), ["doc_id"])
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip(docs_of([]), P.path("byte_bpe_50k.tiktoken"), ["doc_id"]).count() == 0


def test_stream_decoder_waits_for_whole_characters():
    machine = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    assert [machine.feed([b]) for b in "é👍".encode()] == ["", "é", "", "", "", "👍"]
    assert "".join(machine.decode([[0xC3], [0x41, 0xFF]])) == "\ufffdA\ufffd"


# ---- nearest neighbours -------------------------------------------------------------------

def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            near = sorted(((-vptree.exact_products(a[None], b[None])[0], i) for i, b in good if i != q and len(a) == len(b)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, queries_at_once", [(8192, 4096), (40, 3)])
def test_nearest(spark, shard, queries_at_once, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", shard)
    monkeypatch.setattr(vptree, "QUERY_ROWS", queries_at_once)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.5, 1, 3])).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # one vector many times
    rows += [(500, None), (501, [0.0] * 8), (520, [float("nan")] * 8), (540, [1.0, None] * 4), (560, [float("inf")] * 8), (580, []), (600, [1.0, 2.0]), (601, [2.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<double>, score double")
    got = vptree.nearest(table.union(table.where("vec_id = 3")), table.vec_id % 20 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == brute_nearest(rows, 5)
    assert vptree.nearest(table.where("false"), table.vec_id % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["signs", "one-hot", "two values"])
def test_ties_of_different_vectors_go_to_the_smallest_ids(kind):
    rng = np.random.default_rng(3)
    n, k = 3000, 20
    vectors = {"signs": lambda: rng.choice([-1.0, 1.0], (n, 32)), "one-hot": lambda: np.eye(300)[rng.permutation(n) % 300],
               "two values": lambda: rng.choice([0.1, 0.7], (n, 24))}[kind]()
    ids = rng.permutation(10 * n)[:n]
    longest = np.sqrt((vectors**2).sum(1).max()) * (1 + 1e-12)
    row, near, score = vptree.search(ids, vectors, ids[:40], vectors[:40], k, longest)
    got = {(r, i): s for r, i, s in zip(row.tolist(), near.tolist(), score.tolist(), strict=True)}
    want = {}
    for r in range(40):
        exact = vptree.exact_products(np.broadcast_to(vectors[r], vectors.shape), vectors)
        exact[r] = -np.inf
        want |= {(r, int(ids[j])): float(exact[j]) for j in np.lexsort((ids, -exact))[:k]}
    assert len(row) == len(got) and got == want


def test_relaxed_pruning_trades_recall():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16)) * 3
    vectors = centres[rng.integers(0, 30, 4000)] + rng.standard_normal((4000, 16)) * 0.3
    longest = np.sqrt((vectors**2).sum(1).max())
    ids = np.arange(4000)
    exact = set(zip(*vptree.search(ids, vectors, ids[:100], vectors[:100], 10, longest, 1.0)[:2], strict=True))
    wide = vectors[:100] @ vectors.T
    np.fill_diagonal(wide[:, :100], -np.inf)
    assert exact == {(r, i) for r in range(100) for i in np.argsort(-wide[r])[:10]}
    loose = set(zip(*vptree.search(ids, vectors, ids[:100], vectors[:100], 10, longest, 1.3)[:2], strict=True))
    assert len(loose & exact) >= 0.9 * len(exact)


# ---- licences -------------------------------------------------------------------------------

def test_licences(spark, docs_of):
    import duckdb

    mit = license_scan.TEMPLATES[1].text
    rows = [(1, "Released under the MIT License."), (2, "mit\nlicense, MIT-license x apache license"), (3, None), (4, ""), (5, "..."), (6, "the GNU General Public License"),
            (7, f"foo {mit} bar"), (8, mit.replace("free of charge", "free of any charge")), (9, "Licensed under CC BY-NC 4.0."), (10, "cc by nc"), (11, "(licensed) MIT LICENSE"),
            (12, "word " * 20_000 + "Licensed under the Apache License, Version 2.0"), (13, "it is mitlicense é license mit"), (None, "mit license"), (1, "Released under the MIT License.")]
    docs = docs_of(rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    ok, note = compare(license_scan.scan(docs), con, license_scan.twin())
    assert ok, note
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    r = got[2]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (7, 3, 0, 5, "apache,mit")
    assert got[7].labels == "mit" and got[7].score == 1.0 and got[9].labels == "cc-by-nc" and got[9].base_labels == ""
    assert license_scan.scan(docs_of([])).count() == 0
    # other scripts' letters that lower-case to A-Z are no words of a licence; a long text takes time in proportion
    odd = {r.doc_id: r for r in license_scan.scan(docs_of([(1, "this wor\u212a is licensed under the gnu general public license version 3"), (2, "MIT License " * 50_000)])).collect()}
    assert odd[1].score == 11 / 12 and (odd[2].n_words, odd[2].n_base, odd[2].last_word) == (100_000, 50_000, 99_998)


# ---- registered queries and the pipeline -------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert ok, note


def test_other_queries_cover_every_document(spark):
    for name in ("op3_token_files", "op6_bpe_round_trip", "op8_suffix_dedup", "op9_language_id", "op10_ngram_jaccard_join"):
        assert queries.QUERIES[name](spark, SF).count() == 200, name


def test_native_operators_use_no_python(spark):
    for name in ("op1_url_filter", "op7_license_scan"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct")), name


def test_pipeline(spark, docs_of, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))) for i in range(30)]
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(30))
    rows += [(100, rows[0][1]), (101, rows[0][1] + " tail"), (102, rows[3][1] + " " + passage), (103, rows[4][1][::-1] + " " + passage), (104, "12 34 !"), (105, None), (106, rows[5][1][::-1] + " " + item)]
    docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        kept[name] = {r.doc_id: r for r in now.collect()}
        if name != "token_ids":
            assert now.columns == docs.columns
    everyone = {i for i, _ in rows}
    assert set(kept["language"]) == everyone - {104, 105}
    assert set(kept["near_copies"]) == everyone - {104, 105, 100, 101}
    assert passage in kept["repeated_strings"][102].text and passage not in kept["repeated_strings"][103].text
    assert kept["repeated_strings"][103].n_chars == len(kept["repeated_strings"][103].text) and kept["repeated_strings"][7].text == rows[7][1]
    assert set(kept["benchmark_passages"]) == set(kept["near_copies"]) - {106}
    assert {i: r.n_tokens for i, r in kept["token_ids"].items()} == {i: len(ENCODING.encode_ordinary(r.text)) for i, r in kept["benchmark_passages"].items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, kept["token_ids"].values()))


def test_new_pieces_are_encoded_once_and_in_the_order_of_the_text():
    asked, known = [], {" old": b"\7\0\0\0"}

    def encode(pieces):
        asked.extend(pieces)
        return [len(p).to_bytes(4, "little") * 2 for p in pieces]

    words = [" " + "".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11)) for i in range(26)]
    ids, first = pretokens.encode_slice(["".join(words) + " old", "", words[3] + " old"], known, encode, 1000)
    assert asked == list(dict.fromkeys(words))
    assert first.tolist() == [0, 53, 53, 56] and ids.tolist() == [5] * 52 + [7] + [5, 5, 7]
