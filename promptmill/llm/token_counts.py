"""Token counts of whole texts, huge ones in overlapping chunks.

A text longer than ``CHUNK_CHARS`` is cut into chunks that begin ``OVERLAP`` characters before the
last one's end. Every chunk is encoded by itself, with offsets where it overlaps a neighbour, and
two neighbours are spliced at a place of their overlap where both have a boundary that is proven
not to depend on what either could not see:

* behind white space or a digit, and between an ASCII letter and an ASCII punctuation mark other
  than ``|``: a piece of the pre-tokenizer ends there whatever surrounds it, and normalisation
  joins nothing across it;
* in an overlap of letters alone, or of punctuation alone, that lies in one piece: behind a token
  that both have. Merges by rank give a sequence of tokens exactly if they give each two adjacent
  ones from their own characters; the two around the splice are adjacent in one chunk or the other.

A text with a seam that has no such place is cut anew with wider overlaps and longer chunks, until
a chunk holds the whole text, so the counts are always those of the whole text. A tokenizer whose
rules are not those of the proof gets whole texts at once.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.language_id import text_slices
from promptmill.llm.tasks import CACHES, arrow_map, ddl
from promptmill.session import cut_lineage

CHUNK_CHARS = 1 << 15
OVERLAP = 256
WIDEN = 8
MEMO_BYTES = 48 << 20  # of words met before, in a worker
MEMO_WORD = 64  # longer words are not kept
JOINED = 1024  # words handed to the library at once

SPACES = " \n\t\r"
#: Characters that Python's ``split`` takes for white space and the tokenizer does not.
_NO_SPACES = re.compile("[\x1c-\x1f]")
_WORD = re.compile(f"[^{SPACES}]+")
_AFTER = re.compile(rf"[{SPACES}0-9]|[A-Za-z](?=[!-/:-@\[-`{{}}~])")
# letters that normalisation neither changes nor joins to what precedes; marks that begin no contraction and no added token
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿ一-龥가-힣]+")
_MARKS = re.compile(r"[!-&(-/:;=?@\[-`{}~]+")
LEAD = 16  # no contraction or added token that begins before an overlap of letters reaches farther into it

# fixed values: the rules of word-end BPE that the proof is about
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})


def provable(spec: dict) -> bool:
    """Whether a tokenizer's rules are those that the module's proof is about."""
    model, pre, norm = (spec.get(k) or {} for k in ("model", "pre_tokenizer", "normalizer"))
    steps = pre.get("pretokenizers") or []
    return (
        model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("unk_token")
        and norm.get("type") == "Sequence" and all(n in _NORMALIZERS for n in norm["normalizers"])
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and not steps[1].get("add_prefix_space") and steps[1].get("use_regex") is False and not spec.get("truncation") and not spec.get("padding")
        and all(len(t["content"]) <= LEAD and not re.search(r"[\s\d]", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
                and _splits_at_bar(t["content"]) for t in spec.get("added_tokens") or []))


def _splits_at_bar(content: str) -> bool:
    """Whether the only letters of an added token that a mark follows are followed by ``|``."""
    return not any(a.isalpha() and not (b.isalpha() or b == "|") for a, b in zip(content, content[1:], strict=False))


class Counter:
    """Counts tokens of texts; words (runs without white space) met before are not encoded again."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.provable = provable(json.loads(content))
        self.known: dict[str, int] = {}
        self.held = 0

    def counts(self, texts: list[str]) -> list[int]:
        if not self.provable:
            return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [_WORD.findall(t) if _NO_SPACES.search(t) else t.split() for t in texts]
        new = list(set().union(*split).difference(self.known))
        extra = dict(zip(new, self._words(new), strict=True))
        if self.held > MEMO_BYTES:
            extra.update((w, self.known[w]) for w in set().union(*split).intersection(self.known))
            self.known, self.held = {}, 0
        self.known.update(extra)
        out = [sum(map(self.known.__getitem__, words)) for words in split]
        for w in extra:
            if len(w) > MEMO_WORD:
                del self.known[w]
            else:
                self.held += 4 * len(w) + 100
        return out

    def _words(self, words: list[str]) -> list[int]:
        """Tokens of each word; many go to the library in one text, with a blank between them."""
        out: list[int] = []
        for low in range(0, len(words), JOINED):
            some = words[low: low + JOINED]
            end = np.cumsum(np.fromiter((len(w) + 1 for w in some), np.int64, len(some)))
            offsets = self.tokenizer.encode(" ".join(some), add_special_tokens=False).offsets
            start = np.fromiter((a for a, _ in offsets), np.int64, len(offsets))
            out.extend(np.bincount(np.searchsorted(end, start, "right"), minlength=len(some)).tolist())
        return out

    def near(self, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of the tokens that reach into ``text[low:high]``, counted from ``low``."""
        begin = max(text.rfind(c, 0, low) for c in SPACES) + 1
        stop = min((at for at in (text.find(c, high) for c in SPACES) if at >= 0), default=len(text))
        e = self.tokenizer.encode(text[begin:stop], add_special_tokens=False)
        shift = begin - low
        return [(a + shift, b + shift, i) for (a, b), i in zip(e.offsets, e.ids, strict=True) if b + shift > 0 and a + shift < high - low]


def splice(overlap: str, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]]) -> int | None:
    """How many tokens two chunks have too many, or None where no boundary in their overlap is proven.

    ``left`` are the tokens of the earlier chunk that reach into the overlap, ``right`` those of the later one.
    """
    for m in _AFTER.finditer(overlap):
        p = m.end()
        if p < len(overlap) and not any(a < p < b for a, b, _ in left) and not any(a < p < b for a, b, _ in right):
            return sum(a >= p for a, _, _ in left) + sum(a < p for a, _, _ in right)
    if _LETTERS.fullmatch(overlap) or _MARKS.fullmatch(overlap):
        theirs = set(_aligned(right))
        for n, token in enumerate(left):
            if token in theirs and LEAD <= token[0] and token[1] < len(overlap) and token in _aligned(left[max(n - 1, 0): n + 2]):
                return len(left) - n - 1 + right.index(token) + 1
    return None


def _aligned(tokens: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tokens that share no character with a neighbour."""
    return [t for n, t in enumerate(tokens)
            if (n == 0 or tokens[n - 1][1] <= t[0]) and (n + 1 == len(tokens) or tokens[n + 1][0] >= t[1])]


_kept: dict[str, Counter] = {}
CACHES.append(_kept)


def _counter(path: str, content: str) -> Counter:
    if path not in _kept:
        _kept.clear()
        _kept[path] = Counter(content)
    return _kept[path]


def count(docs: DataFrame, path: str, keys: list[str], text: str = "text", limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``keys``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``path`` is a file of the tokenizers library. A null text counts as an empty one, with no bytes and no tokens.
    Rows that repeat are counted each for itself. Columns besides ``keys`` and ``text`` do not matter.
    """
    content = open(path, encoding="utf-8").read()
    whole_only = not provable(json.loads(content))
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary, some MB
    chosen = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    columns = f"{ddl(chosen, keys)}, n_bytes bigint, n_tokens bigint".lstrip(", ")

    def run(batches):
        counter = _counter(path, shared.value)
        for batch in batches:
            texts = batch.column("_text")
            for at, some in text_slices(texts.to_pylist()):
                bytes_ = [len(t.encode()) for t in some]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, len(some)) for k in keys), pa.array(bytes_, pa.int64()), pa.array(counter.counts(some), pa.int64())],
                    [*keys, "n_bytes", "n_tokens"])

    long = F.lit(False) if whole_only else F.length("_text") > chunk
    found = arrow_map(chosen.where(~long), run, columns)
    if not whole_only:
        rest = cut_lineage(chosen.where(long).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
        while not rest.isEmpty():
            done, open_rows = _spliced(rest, path, shared, keys, chunk, overlap)
            found = found.unionByName(done)
            overlap *= WIDEN
            chunk = max(chunk, 4 * overlap)
            rest = rest.join(open_rows, "_row", "left_semi")
            found = found.unionByName(arrow_map(rest.where(F.length("_text") <= chunk), run, columns))
            rest = rest.where(F.length("_text") > chunk)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


_CHUNK = "_row bigint, _no int, _lead int, _last boolean, _part string"
_SIDE = "_row bigint, _seam int, _left boolean, _n bigint, _size bigint, _overlap string, _starts array<int>, _ends array<int>, _ids array<int>"


def _spliced(rest: DataFrame, path: str, shared, keys: list[str], chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Rows all of whose seams are proven, counted; and ``_row`` of the others."""

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                stops = [*range(chunk, len(text), chunk), len(text)]
                for no, stop in enumerate(stops):
                    low = no * chunk
                    lead = overlap if no else 0
                    own = {"_row": row, "_no": no, "_lead": lead, "_last": no == len(stops) - 1, "_part": text[low - lead: stop]}
                    yield pa.RecordBatch.from_pylist([own], _arrow_chunk())

    def encode(batches):
        counter = _counter(path, shared.value)
        for batch in batches:
            out = []
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                part, lead = row["_part"], row["_lead"]
                own = {"_row": row["_row"], "_n": counter.counts([part])[0], "_size": len(part[lead:].encode())}
                if not row["_last"]:
                    out.append(own | _side(counter, part, len(part) - overlap, len(part), row["_no"] + 1, True))
                if lead:  # the chunk itself is counted with its left side only, or with its right one where that is all it has
                    out.append((own if row["_last"] else own | {"_n": 0, "_size": 0}) | _side(counter, part, 0, lead, row["_no"], False))
            yield pa.RecordBatch.from_pylist(out, _arrow_side())

    def join(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                (left, right) = ([*zip(r[s]["_starts"], r[s]["_ends"], r[s]["_ids"], strict=True)] for s in ("l", "r"))
                excess = splice(r["l"]["_overlap"], left, right)
                out.append({"_row": r["_row"], "n": None if excess is None else r["n"] - excess, "size": r["size"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_row", pa.int64()), ("n", pa.int64()), ("size", pa.int64())]))

    # chunks of one text are spread, so no text keeps a task busy alone
    chunks = arrow_map(rest.select("_row", "_text"), cut, _CHUNK).repartition("_row", "_no")
    sides = arrow_map(chunks, encode, _SIDE)
    tokens = F.struct("_overlap", "_starts", "_ends", "_ids")
    # exactly two rows meet at a seam
    seams = sides.groupBy("_row", "_seam").agg(
        F.max(F.when(F.col("_left"), tokens)).alias("l"), F.max(F.when(~F.col("_left"), tokens)).alias("r"),
        F.sum("_n").alias("n"), F.sum("_size").alias("size"))
    judged = cut_lineage(arrow_map(seams.select("_row", "l", "r", "n", "size"), join, "_row bigint, n bigint, size bigint"), "seams")
    texts = judged.groupBy("_row").agg(
        F.sum("n").alias("n_tokens"), F.sum("size").alias("n_bytes"), F.bool_or(F.col("n").isNull()).alias("_open"))
    named = rest.select("_row", *keys)
    done = named.join(texts.where(~F.col("_open")), "_row").select(*keys, "n_bytes", "n_tokens")
    return done, texts.where("_open").select("_row")


def _side(counter: Counter, part: str, low: int, high: int, seam: int, left: bool) -> dict:
    near = counter.near(part, low, high)
    starts, ends, ids = ([*x] for x in zip(*near, strict=True)) if near else ([], [], [])
    return {"_seam": seam, "_left": left, "_overlap": part[low:high], "_starts": starts, "_ends": ends, "_ids": ids}


def _arrow_chunk() -> pa.Schema:
    return pa.schema([("_row", pa.int64()), ("_no", pa.int32()), ("_lead", pa.int32()), ("_last", pa.bool_()), ("_part", pa.string())])


def _arrow_side() -> pa.Schema:
    ints = pa.list_(pa.int32())
    return pa.schema([
        ("_row", pa.int64()), ("_seam", pa.int32()), ("_left", pa.bool_()), ("_n", pa.int64()), ("_size", pa.int64()), ("_overlap", pa.string()),
        ("_starts", ints), ("_ends", ints), ("_ids", ints)])
