"""Token ids of a corpus in files of patched frame-of-reference blocks.

A table of segments in Parquet is the container. A segment holds whole documents, in ascending
order of their ids over all segments: ``part`` and ``segment`` give its place, ``first`` the
number of ids before it in its part, ``doc_ids`` and ``lengths`` its documents, ``payload`` the
packed ids and ``block_starts`` where each block of ``BLOCK`` ids begins in it, so that a reader can
open any block by itself. A block is

    minimum u32 | width u8 | exceptions u16 | packed (id - minimum), low bits, first id first
    | places of the exceptions, u8 each | their full differences, u32 each

with the width that costs least among those that the ``PERCENTILES`` of the differences ask for;
larger differences are the exceptions. The last block is filled up with its minimum.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptmill.llm.language_id import text_slices
from promptmill.llm.pretokens import encode_slice
from promptmill.llm.tasks import CACHES, arrow_map, ddl

BLOCK = 256
HEADER = 7
PERCENTILES = (50, 75, 90, 95, 98, 100)
SEGMENT_IDS = 1 << 18
MAX_PIECES = 800_000
JOINED = 256  # pieces handed to the library at once


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of unsigned 32-bit values."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(payload bytes, block starts) of ids below 2**32."""
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    n = -(-len(ids) // BLOCK)
    grid = np.empty(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    tail = grid[(n - 1) * BLOCK: len(ids)]
    grid[len(ids):] = tail.min()
    grid = grid.reshape(n, BLOCK)
    low = grid.min(1)
    rest = grid - low[:, None]
    ranked = np.sort(rest, 1)
    best, width = np.full(n, 1 << 62), np.zeros(n, np.int64)
    for p in PERCENTILES:
        w = _bits(ranked[:, -(-BLOCK * p // 100) - 1])
        over = (rest >> np.minimum(w, 31).astype(np.uint32)[:, None] > 0).sum(1) * (w < 32)
        cost = w * BLOCK // 8 + 5 * over
        better = cost < best
        best[better], width[better] = cost[better], w[better]
    large = (rest >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0) & (width < 32)[:, None]
    count = large.sum(1)
    size = HEADER + width * BLOCK // 8 + 5 * count
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(start[-1], np.uint8)
    at = start[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at + 4] = width
    out[at[:, None] + 5 + np.arange(2)] = count.astype("<u2").view(np.uint8).reshape(n, 2)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            bits = np.unpackbits(rest[mine].astype("<u4").view(np.uint8).reshape(len(mine), BLOCK, 4), axis=2, bitorder="little", count=int(w))
            packed = np.packbits(bits.reshape(len(mine), -1), axis=1, bitorder="little")
            out[at[mine][:, None] + HEADER + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(large)
    nth = np.arange(len(block)) - np.concatenate(([0], np.cumsum(count)))[block]
    after = at + HEADER + width * BLOCK // 8
    out[after[block] + nth] = place
    values = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(after + count)[block][:, None] + 4 * nth[:, None] + np.arange(4)] = values
    return out, at


def unpack(payload: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` (all of them, or a run of them)."""
    n = len(starts)
    at = starts.astype(np.int64)
    low = payload[at[:, None] + np.arange(4)].reshape(-1).view("<u4").astype(np.uint32) if n else np.zeros(0, np.uint32)
    width = payload[at + 4].astype(np.int64)
    count = payload[at[:, None] + 5 + np.arange(2)].reshape(-1).view("<u2").astype(np.int64) if n else width
    rest = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            packed = payload[at[mine][:, None] + HEADER + np.arange(w * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
            full = np.zeros((len(mine), BLOCK, 32), np.uint8)
            full[:, :, :w] = bits
            rest[mine] = np.packbits(full, axis=2, bitorder="little").reshape(len(mine), -1).view("<u4")
    block = np.repeat(np.arange(n), count)
    nth = np.arange(len(block)) - np.concatenate(([0], np.cumsum(count)))[block]
    after = at + HEADER + width * BLOCK // 8
    place = payload[after[block] + nth]
    values = payload[(after + count)[block][:, None] + 4 * nth[:, None] + np.arange(4)].reshape(-1).view("<u4") if len(block) else np.zeros(0, np.uint32)
    rest[block, place] = values
    return (rest + low[:, None]).reshape(-1)[:n_ids]


class Library:
    """A tokenizer of the tokenizers library over many texts.

    For byte-level BPE with the usual pieces (no normaliser, no dropout), equal pieces of a slice
    are encoded once, and pieces of a blank and letters many at a time. Texts that hold one of
    the tokenizer's added tokens, and all texts of other tokenizers, are encoded as they are.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(content), {}
        spec = json.loads(content)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
            and not spec.get("truncation") and model.get("type") == "BPE" and not model.get("dropout"))
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.plain = not any(t.get("normalized") and t.get("single_word") for t in spec.get("added_tokens") or [])

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        coded: list = [None] * len(pieces)
        words, others = [], []
        for i, p in enumerate(pieces):
            (words if p[0] == " " and p[1:].isalpha() else others).append(i)
        for i, e in zip(others, self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False), strict=True):
            coded[i] = array("I", e.ids).tobytes()
        for low in range(0, len(words), JOINED):
            some = words[low: low + JOINED]
            e = self.tokenizer.encode("".join(pieces[i] for i in some), add_special_tokens=False)
            ids, word = array("I", e.ids).tobytes(), np.array(e.word_ids)
            cut = [0, *(4 * np.flatnonzero(word[1:] != word[:-1]) + 4).tolist(), len(ids)]
            if len(cut) != len(some) + 1:
                raise ValueError("the tokenizer cuts pieces of a blank and letters otherwise")
            for i, a, b in zip(some, cut, cut[1:], strict=False):
                coded[i] = ids[a:b]
        return coded

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and the first of each."""
        whole = [i for i, t in enumerate(texts) if not self.by_piece or any(a in t for a in self.added)]
        if not whole:
            return encode_slice(texts, self.known, self._pieces, MAX_PIECES)
        special = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in whole}
        ids, first = encode_slice(["" if i in special else t for i, t in enumerate(texts)], self.known, self._pieces, MAX_PIECES)
        parts = [special[i] if i in special else ids[first[i]: first[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_kept: dict[str, Library] = {}
CACHES.append(_kept)


def _library(path: str, content: str) -> Library:
    if path not in _kept:
        _kept.clear()
        _kept[path] = Library(content)
    return _kept[path]


def _segments(path: str, content, end_id: int | None) -> Callable:
    """Rows sorted by document to segments of one part, which is the task's."""

    def run(batches):
        library = _library(path, content.value)
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal segment, first, held
            flat = np.concatenate(ids)
            payload, starts = pack(flat)
            name = pa.concat_arrays(names)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                pa.ListArray.from_arrays(np.array([0, len(name)], np.int32), name), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                pa.array([starts], pa.list_(pa.int64())), pa.array([payload.tobytes()], pa.binary())],
                ["part", "segment", "first", "doc_ids", "lengths", "block_starts", "payload"])
            segment, first, held = segment + 1, first + len(flat), 0
            names.clear(), ids.clear(), lengths.clear()
            return row

        for batch in batches:
            for at, some in text_slices(batch.column("_text").to_pylist(), 1_000_000):
                flat, cut = library.encode(some)
                if end_id is not None:
                    flat, cut = np.insert(flat, cut[1:], end_id), cut + np.arange(len(cut))
                low = 0
                while low < len(some):  # whole documents, up to the size of a segment
                    high = max(low + 1, int(np.searchsorted(cut, cut[low] + max(0, SEGMENT_IDS - held), "right")) - 1)
                    names.append(batch.column("_doc").slice(at + low, high - low))
                    ids.append(flat[cut[low]: cut[high]].astype(np.uint32))
                    lengths.append(np.diff(cut[low: high + 1]))
                    held += int(cut[high] - cut[low])
                    low = high
                    if held >= SEGMENT_IDS:
                        yield close()
        if names:
            yield close()

    return run


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = None, id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text (null: empty) and write the ids in ascending order of ``id`` to ``out``.

    Null ids come first; rows that share an id are ordered by their text. ``end_id`` is put behind each document.
    Only the narrow order columns decide the ranges, and a range is one part.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())  # a vocabulary, some MB
    rows = docs.select(F.col(id).alias("_doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    ordered = rows.repartitionByRange("_doc", "_tie").sortWithinPartitions("_doc", "_tie", "_text").select("_doc", "_text")
    kind = rows.schema["_doc"].dataType.simpleString()
    schema = f"part int, segment int, first bigint, doc_ids array<{kind}>, lengths array<bigint>, block_starts array<bigint>, payload binary"
    arrow_map(ordered, _segments(tokenizer, content, end_id), schema).write.parquet(out)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the number of ids in all earlier segments of all parts."""
    segments = spark.read.parquet(path)
    # one row per part, i.e. per task that wrote; the aggregation reads two narrow columns
    sums = segments.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.join(F.broadcast(sums.select("part", before.alias("_before"))), "part").withColumn("start", F.col("_before") + F.col("first"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<long>) per document from the files."""
    return _read(spark, path, False)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document from the files."""
    return _read(spark, path, True)


def _read(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    segments = _placed(spark, path).select("start", "doc_ids", "lengths", "block_starts", "payload")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                length = batch.column("lengths")[r].values.to_numpy()
                cut = np.concatenate(([0], np.cumsum(length)))
                payload = np.frombuffer(batch.column("payload")[r].as_buffer(), np.uint8)
                ids = unpack(payload, batch.column("block_starts")[r].values.to_numpy(), int(cut[-1]))
                own = [batch.column("doc_ids")[r].values, pa.array(batch.column("start")[r].as_py() + cut[:-1])]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(ids.astype(np.int64)))], ["doc_id", "start", "ids"])

    rest = "n_tokens bigint, ids_crc32 bigint" if digest else "ids array<bigint>"
    return arrow_map(segments, run, f"doc_id {kind}, start bigint, {rest}")
