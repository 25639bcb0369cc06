"""Removal of byte strings that occur before, whole documents and all of them together.

A byte goes when a string of ``length`` bytes around it also starts earlier. Every window of that
length is represented by a sample: the place, of its substrings of ``GRAM`` bytes, with the least
hash. Equal windows have equal samples at equal distances, so the samples cover all differences
between two occurrences, and only one place in 35 has to be named.

1. Samples are named by their hash; sorted by name, those that stand alone drop out.
2. The context of a sample (all windows that it represents, laid over each other) is named, too. Sorted
   by name, context and document, all but the first of equal contexts go as a whole.
3. Where a sample has several contexts, their windows are sorted, and neighbours compared.

Names are combined per slice before they are shuffled. Samples with more than ``HOT`` places, which
no task should hold, take the same steps as aggregations by context and by window instead.
Places within a document are compared in the task that reads it; between documents the smaller id
is the earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.llm.jaccard import _groups, membership
from promptmill.llm.tasks import arrow_map, ddl
from promptmill.llm.words import _BYTE_CODE, powers, slices
from promptmill.session import cut_lineage

LENGTH = 100
GRAM = 32
SLICE = 1 << 19
HOT = 20_000  # places of a sample that one task may hold
FIRST_ID = -(1 << 63)  # order of a null id


def _scrambled(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Samples:
    """Samples of the rows of a slice: name, the row, first window and number of windows of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.length = data, length
        n, gram = len(data), min(GRAM, length)
        self.up, self.down = powers(n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * self.up[:n], out=self.sum[1:])
        if n < length:
            self.name = np.zeros(0, np.uint64)
            self.row = self.start = self.count = np.zeros(0, np.int64)
            self.loop = np.zeros(0, bool)
            return
        grams = _scrambled((self.sum[gram:] - self.sum[:-gram]) * self.down[: n - gram + 1])
        least = grams
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have:])
        # windows that lie within one row, and where their sample changes
        inside = np.diff(offsets) >= length
        whole = np.zeros(len(least) + 1, np.int8)
        np.add.at(whole, offsets[:-1][inside], 1)
        np.add.at(whole, offsets[1:][inside] - length + 1, -1)
        whole = np.cumsum(whole, dtype=np.int8)[:-1].astype(bool)
        change = np.ones(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        change[offsets[:-1][offsets[:-1] < len(least)]] = True
        self.start = np.flatnonzero(whole & change)
        stop = np.append(np.flatnonzero(change), len(least))
        end = stop[np.searchsorted(stop, self.start, "right")]
        row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.minimum(end, offsets[row + 1] - length + 1) - self.start
        self.name, self.row = least[self.start], row
        # equal windows within one place: then two of its substrings are the least, one of them first in its window, the other one last
        size = len(self.start)
        ends = np.zeros((2, size), np.int64)
        total = np.zeros((2, size), np.int64)
        for k, shift in enumerate((0, width - 1)):
            window = np.flatnonzero(grams[shift: shift + len(least)] == least)
            place = np.searchsorted(self.start, window, "right") - 1
            use = (place >= 0) & (window < (self.start + self.count)[place]) if size else np.zeros(len(window), bool)
            ends[k] = np.bincount(place[use], minlength=size)
            total[k] = np.bincount(place[use], window[use] + shift, minlength=size)
        self.loop = (ends > 1).any(0) | ((ends == 1).all(0) & (total[0] != total[1]))

    def hashes(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _scrambled((self.sum[start + size] - self.sum[start]) * self.down[start] + np.asarray(size, np.uint64))

    def contexts(self) -> np.ndarray:
        return self.hashes(self.start, self.count + self.length - 1)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Whether a place is the first one with its values."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    order = np.lexsort(columns[::-1])
    same = np.ones(len(order), bool)
    same[0] = False
    for c in columns:
        same[1:] &= c[order][1:] == c[order][:-1]
    out = np.empty(len(order), bool)
    out[order] = ~same
    return out


def _has(bits, size: int, name: np.ndarray) -> np.ndarray:
    slot = name & np.uint64(size - 1)
    return (bits.value[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()], list(columns))


def _parts(batches, length: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, Samples]]:
    for batch in batches:
        for at, end, data, offsets in slices(batch.column("text"), SLICE):
            yield batch, at, end, offsets, Samples(data, offsets, length)


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every run, and the run of every place, where ``change`` marks starts."""
    return np.flatnonzero(change), np.cumsum(change) - 1


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _names(length: int) -> Callable:
    """(name, context, n): places of each context in a slice; one that repeats itself counts for two contexts."""

    def run(batches):
        for _, _, _, _, s in _parts(batches, length):
            context = s.contexts()
            order = np.lexsort((context, s.name))
            name, context, loop = s.name[order], context[order], s.loop[order]
            start, of = _runs(_changes(name, context))
            n = np.bincount(of, minlength=len(start)).astype(np.int64)
            again = np.bincount(of, loop, minlength=len(start)) > 0
            yield _batch({
                "name": np.concatenate([name[start], name[start][again]]), "context": np.concatenate([context[start], ~context[start][again]]),
                "n": np.concatenate([n, n[again]])})

    return run


def _repeated(batches) -> Iterator[pa.RecordBatch]:
    """Names, from rows sorted by name and context, of more than one place: (name, n, contexts)."""
    last: tuple[int, int, int, int] | None = None  # name, n, contexts and last context so far
    for batch in batches:
        name, context, n = (batch.column(k).to_numpy() for k in ("name", "context", "n"))
        if not len(name):
            continue
        start, of = _runs(_changes(name))
        total = np.bincount(of, n, minlength=len(start)).astype(np.int64)
        kinds = np.bincount(of, _changes(name, context), minlength=len(start)).astype(np.int64)
        out = []
        if last is not None:
            if last[0] == name[0]:
                total[0] += last[1]
                kinds[0] += last[2] - (last[3] == context[0])
            else:
                out.append(last[:3])
        last = int(name[-1]), int(total[-1]), int(kinds[-1]), int(context[-1])
        use = np.flatnonzero(total[:-1] > 1)
        yield _batch({"name": name[start][use], "n": total[use], "contexts": kinds[use]})
        if out and out[0][1] > 1:
            yield _batch({k: np.array([v]) for k, v in zip(("name", "n", "contexts"), out[0], strict=True)})
    if last is not None and last[1] > 1:
        yield _batch({k: np.array([v]) for k, v in zip(("name", "n", "contexts"), last[:3], strict=True)})


PLACES = "name bigint, context bigint, doc bigint, tid bigint, start bigint, n bigint, again boolean, hot boolean, bytes binary"


def _places(length: int, all_names, several, hot) -> Callable:
    """Places of samples that occur again; ``again`` if the context was before in the text; ``bytes`` where a sample has several contexts."""

    def run(batches):
        for batch, at, end, offsets, s in _parts(batches, length):
            doc, tid = (batch.column(k).to_numpy()[at:end] for k in ("doc", "tid"))
            use = np.flatnonzero(_has(*all_names, s.name))
            name, context, row, start, n = s.name[use], s.contexts()[use], s.row[use], s.start[use], s.count[use]
            first = _first_of(name, context, row)
            need = _has(*several, name) & first
            raw = s.data.tobytes()
            cut = [raw[a:b] if x else None for a, b, x in zip(start.tolist(), (start + n + length - 1).tolist(), need.tolist(), strict=True)]
            plain = _batch({
                "name": name, "context": context, "doc": doc[row], "tid": tid[row], "start": start - offsets[row], "n": n, "again": ~first, "hot": _has(*hot, name)})
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(cut, pa.binary())], [*plain.schema.names, "bytes"])

    return run


def _window_hashes(part: pa.RecordBatch, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the window in its place, hash) of all windows of some rows with bytes."""
    column = part.column("bytes").take(pa.array(rows))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    n = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(rows)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = nth + offsets[row]
    return rows[row], nth, _scrambled((total[at + length] - total[at]) * down[at])


def _compare(length: int) -> Callable:
    """Spans that start earlier, from places sorted by name, context, document, text and start."""

    def run(batches):
        for part, _ in _groups(batches, ["name"]):
            name, context, doc, tid, start, n = (part.column(k).to_numpy() for k in ("name", "context", "doc", "tid", "start", "n"))
            again = part.column("again").to_numpy(zero_copy_only=False)
            begin, of = _runs(_changes(name, context))
            gone = again | (doc > doc[begin][of])
            out = [(doc[gone], tid[gone], start[gone], n[gone])]
            wide = ~gone & part.column("bytes").is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(wide)
            if len(rows):
                row, nth, window = _window_hashes(part, rows, length)
                at = start[row] + nth
                order = np.lexsort((at, tid[row], doc[row], window, name[row]))
                row, nth, window, at = row[order], nth[order], window[order], at[order]
                same_window, of_window = _runs(_changes(name[row], window))
                same_text, of_text = _runs(_changes(name[row], window, doc[row], tid[row]))
                hit = (doc[row] > doc[row][same_window][of_window]) | (at > at[same_text][of_text])
                row, nth = row[hit], nth[hit]
                order = np.lexsort((nth, row))
                row, nth = row[order], nth[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)
                head, _ = _runs(fresh)
                out.append((doc[row[head]], tid[row[head]], start[row[head]] + nth[head], np.diff(np.append(head, len(row)))))
            yield _batch({k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("doc", "tid", "start", "n"))})

    return run


def _windows(length: int) -> Callable:
    """A row per window of the places: (name, window, doc, tid, start)."""

    def run(batches):
        for part in batches:
            name, doc, tid, start = (part.column(k).to_numpy() for k in ("name", "doc", "tid", "start"))
            for low in range(0, len(part), 1000):
                row, nth, window = _window_hashes(part, np.arange(low, min(low + 1000, len(part))), length)
                yield _batch({"name": name[row], "window": window, "doc": doc[row], "tid": tid[row], "start": start[row] + nth})

    return run


def _hot_spans(places: DataFrame, length: int) -> DataFrame:
    """The same spans for samples of any number of places, by aggregations only."""
    firsts = places.groupBy("name", "context").agg(F.min("doc").alias("first"))
    judged = places.join(firsts, ["name", "context"])
    gone = judged.where("again or doc > first").select("doc", "tid", "start", "n")
    left = judged.where("not again and doc = first and bytes is not null").select("name", "doc", "tid", "start", "bytes")
    windows = arrow_map(left, _windows(length), "name bigint, window bigint, doc bigint, tid bigint, start bigint")
    here = windows.groupBy("name", "window", "doc", "tid").agg(F.min("start").alias("start0"))
    least = windows.groupBy("name", "window").agg(F.min("doc").alias("first"))
    hit = windows.join(least, ["name", "window"]).join(here, ["name", "window", "doc", "tid"]).where("doc > first or start > start0")
    return gone.unionByName(hit.select("doc", "tid", "start", F.lit(1).cast("bigint").alias("n")))


def spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc, tid, start, n): windows start .. start + n - 1 of a text also start earlier.

    ``docs`` has ``doc`` (its order), ``tid`` (which text, should several have one ``doc``) and ``text``.
    """
    named = arrow_map(docs.select("text"), _names(length), "name bigint, context bigint, n bigint")
    repeated = cut_lineage(arrow_map(
        named.repartition("name").sortWithinPartitions("name", "context"), _repeated, "name bigint, n bigint, contexts bigint"), "samples")
    sets = [membership(repeated.where(which).select(F.col("name").alias("key"))) for which in (F.lit(True), F.col("contexts") > 1, F.col("n") > hot)]
    places = cut_lineage(arrow_map(docs.select("doc", "tid", "text"), _places(length, *[(bits, size) for size, bits in sets]), PLACES), "places")
    order = ["name", "context", "doc", "tid", "start"]
    few = places.where("not hot").repartition("name").sortWithinPartitions(*order)
    return arrow_map(few, _compare(length), "doc bigint, tid bigint, start bigint, n bigint").unionByName(_hot_spans(places.where("hot"), length))


def _kept(length: int, keys: list[str], as_text: bool = False) -> Callable:
    """What is left of each text: as bytes, or as text without characters that were cut in two."""

    def run(batches):
        for batch in batches:
            texts, found = batch.column("text"), batch.column("spans").to_pylist()
            out = []
            for i, some in enumerate(found):
                text = (texts[i].as_py() or "").encode()
                begin, end = _merged(some or [], length)
                size = int((end - begin).sum())
                if len(begin):
                    cut = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True))
                else:
                    kept = text
                out.append((len(text), size, len(begin), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), *(pa.array([o[j] for o in out], k) for j, k in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])),
                 pa.array([o[4].decode("utf-8", "ignore") for o in out], pa.string()) if as_text else pa.array([o[4] for o in out], pa.binary())],
                [*keys, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text" if as_text else "kept"])

    return run


def _merged(some: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of bytes: begin and end."""
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.array([s["start"] for s in some])
    end = begin + np.array([s["n"] for s in some]) + length - 1
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate(([True], begin[1:] > reach[:-1]))
    return begin[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)]


def _joined(docs: DataFrame, id: str, text: str, length: int) -> DataFrame:
    """(_row: all columns, text, spans) of every row."""
    order = F.coalesce(F.col(id).cast("bigint"), F.lit(FIRST_ID))
    source = docs.select(F.struct("*").alias("_row"), order.alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("tid", F.xxhash64("text"))
    found = spans(source.select("doc", "tid", "text"), length)
    by_doc = found.groupBy("doc", "tid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return source.join(by_doc, ["doc", "tid"], "left").select("_row", "text", "spans")


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``id``, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A null text is empty. Strings are judged on the input. An earlier start is one in a row with a
    smaller id (null is the smallest) or earlier in the same row; rows that share an id are at the
    same place and remove nothing from each other, but are otherwise judged together.
    """
    joined = _joined(docs, id, text, length).select(F.col("_row")[id].alias("_id"), "text", "spans")
    kind = docs.schema[id].dataType.simpleString()
    return arrow_map(joined, _kept(length, ["_id"]), f"_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").withColumnRenamed("_id", id)


def rewrite(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(_row: all columns of ``docs``, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row; a character cut in two is left out of ``kept_text``."""
    joined = _joined(docs, id, text, length)
    return arrow_map(joined, _kept(length, ["_row"], True), f"{ddl(joined, ['_row'])}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
