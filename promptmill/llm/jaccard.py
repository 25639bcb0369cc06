"""Join of texts whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. Texts with the same word sequence have the same set: one representative stands for them.
2. MinHash signatures are cut into bands of rows, chosen so that a pair at the threshold shares a
   band with the target probability; representatives are shuffled on the band hashes.
3. Every bucket is cut into blocks of bounded size and pairs of blocks, so a hot bucket spreads
   over many tasks and no pair ever becomes a row. A pair belongs to the first band it shares.
4. The full n-gram sets travel only to blocks where their text has such a pair; there all pairs
   are verified exactly, and each text's links, weighted by the number of copies, are counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.components import components
from promptmill.llm.tasks import arrow_map
from promptmill.llm.words import mixed, sequence_hashes, shingles_of, slices, words_of
from promptmill.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 96
BLOCK = 512
PAIRS_AT_ONCE = 1 << 18


def choose_bands(similarity: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows with the most rows (the fewest false candidates) that ``max_hashes`` allow for the recall at the threshold."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = similarity**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 1e-12 else max_hashes + 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"{max_hashes} hashes cannot reach a recall of {recall} at {similarity}")
    return best


def band_hashes(shingle: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of the texts that have n-grams."""
    full = np.flatnonzero(np.diff(first))
    at = first[full]
    out = np.zeros((len(full), bands), np.uint64)
    scale = np.random.default_rng(7).integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    for b in range(bands):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            low = np.minimum.reduceat((shingle * scale[b * rows + r]) >> np.uint64(32), at) if len(full) else key
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, b] = key
    return out


def _signatures(n: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in slices(batch.column("text")):
                words = words_of(data, offsets)
                shingle, first = shingles_of(words, n)
                one, two = sequence_hashes(words)
                full = np.diff(first) > 0
                keys = band_hashes(shingle, first, bands, rows).view(np.int64)
                size = np.where(full, bands, 0)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, end - at), pa.array(one, mask=~full), pa.array(two, mask=~full), lists], ["id", "s1", "s2", "bands"])

    return run


def membership(keys: DataFrame) -> tuple[int, object]:
    """A bitmap (broadcast) of hashed keys, to leave out most rows before a join: its size in bits, 2**27 at most, and itself.

    It has false positives, more of them when there are many keys, but never a false negative.
    """
    size = 1 << min(27, max(16, (16 * keys.count()).bit_length()))
    slots = keys.select(F.pmod("key", F.lit(size)).alias("slot"))
    words = slots.groupBy(F.expr("slot div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("v")).toArrow()
    bits = np.zeros(size // 32, np.uint32)
    bits[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)
    return size, keys.sparkSession.sparkContext.broadcast(bits)


def _sets(n: int, bits) -> Callable:
    """Word sequence hashes and n-gram sets of the rows whose id may be one of a representative that is needed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            use = (bits.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) == 1
            for _, _, data, offsets in slices(batch.column("text").filter(pa.array(use))):
                words = words_of(data, offsets)
                shingle, first = shingles_of(words, n)
                one, two = sequence_hashes(words)
                sets = [np.unique(shingle[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                begin = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(begin, pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), lists], ["s1", "s2", "grams"])

    return run


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of whole groups (rows sorted by ``keys``) with the starts of the groups and the end; groups are of bounded size."""
    rest: list[pa.RecordBatch] = []

    def starts(part: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(len(part), bool)
        change[:1] = True
        for k in keys:
            v = part.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not len(batch):
            continue
        part = pa.concat_batches([*rest, batch]) if rest else batch
        at = starts(part)
        if at[-1]:
            yield part.slice(0, at[-1]), at
        rest = [part.slice(at[-1])]
    if rest:
        yield rest[0], np.array([0, len(rest[0])])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _pairs(part: pa.RecordBatch, at: np.ndarray, bands: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to be verified: in one group, of the wanted blocks, for which its band is the first they share."""
    block, same = part.column("block").to_numpy(), part.column("p").to_numpy() == part.column("q").to_numpy()
    key, band = _matrix(part.column("bands"), bands), part.column("band").to_numpy()
    sizes = np.diff(at)
    # i runs over all rows, j over the later rows of its group
    later = np.repeat(at[1:], sizes) - np.arange(at[-1]) - 1
    row = 0
    total = np.concatenate(([0], np.cumsum(later)))
    while row < len(later):
        end = max(row + 1, int(np.searchsorted(total, total[row] + PAIRS_AT_ONCE, "right")) - 1)
        n = later[row:end]
        i = np.repeat(np.arange(row, end), n)
        j = i + 1 + np.arange(total[end] - total[row]) - np.repeat(total[row:end] - total[row], n)
        wanted = same[i] | (block[i] != block[j])
        i, j = i[wanted], j[wanted]
        first = (key[i] == key[j]).argmax(1) == band[i]
        yield i[first], j[first]
        row = end


def _needed(bands: int) -> Callable:
    """Rows of a block that have at least one pair to be verified there."""

    def run(batches):
        for part, at in _groups(batches, ["bucket", "p", "q"]):
            use = np.zeros(len(part), bool)
            for i, j in _pairs(part, at, bands):
                use[i] = use[j] = True
            yield part.filter(pa.array(use))

    return run


def _verify(bands: int, similarity: float) -> Callable:
    """Per row of a block: links found there, weighted by copies, and a smaller node of the same component."""

    def run(batches):
        for part, at in _groups(batches, ["bucket", "p", "q"]):
            node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
            grams = part.column("grams")
            offset = grams.offsets.to_numpy()
            gram = grams.values.to_numpy()
            size = np.diff(offset)
            links, peer = np.zeros(len(part), np.int64), node.copy()
            pairs = [x for x in _pairs(part, at, bands)]
            left, right = (np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
            # near in size: a smaller set can hold at most all of its own n-grams
            fits = np.minimum(size[left], size[right]) >= similarity * np.maximum(size[left], size[right]) - 1e-9
            left, right = left[fits], right[fits]
            cut = np.searchsorted(left, at)
            for g in np.flatnonzero(np.diff(cut)):
                i, j = left[cut[g]: cut[g + 1]], right[cut[g]: cut[g + 1]]
                a, b = at[g], at[g + 1]
                shared = _shared(gram[offset[a]: offset[b]], size[a:b], i - a, j - a)
                ok = shared >= similarity * (size[i] + size[j] - shared) - 1e-9
                i, j = i[ok], j[ok]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                while len(i):  # smallest node along the links of this block
                    low = np.minimum(peer[i], peer[j])
                    was = peer[a:b].copy()
                    np.minimum.at(peer, i, low)
                    np.minimum.at(peer, j, low)
                    if (was == peer[a:b]).all():
                        break
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (node, links, peer)], ["node", "links", "peer"])

    return run


def _shared(gram: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of common n-grams of the wanted pairs among the sets of one block."""
    owner = np.repeat(np.arange(len(size)), size)
    if len(i) <= 4:
        at = np.concatenate(([0], np.cumsum(size)))
        return np.array([len(np.intersect1d(gram[at[x]: at[x + 1]], gram[at[y]: at[y + 1]], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    values, place, count = np.unique(gram, return_inverse=True, return_counts=True)
    several = count > 1  # others are shared by nobody
    column = np.cumsum(several) - 1
    use = several[place]
    owner, place = owner[use], column[place[use]]
    total = np.zeros((len(size), len(size)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = 4096
    for low in range(0, int(several.sum()), width):
        a, b = np.searchsorted(place, [low, low + width])
        one = np.zeros((len(size), width), np.float32)
        one[owner[a:b], place[a:b] - low] = 1
        total += one @ one.T
    return np.rint(total[i, j]).astype(np.int64)


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``class_id``, ``n_links``, ``n_copies``.

    ``n_links`` is the number of other rows with a similarity of at least ``similarity`` (equal word
    sequences included, ``n_copies`` of them with the row itself); ``class_id`` is the smallest id
    among the rows that are connected by links. Null texts and texts without a word have no links and
    are their own class with ``n_copies`` 1. Texts of fewer than ``n`` words have one n-gram, the
    whole text. Rows that repeat count as copies, with the same id or not.
    """
    bands, rows = choose_bands(similarity, recall)
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    signed = cut_lineage(arrow_map(source, _signatures(n, bands, rows), f"id {id_type}, s1 bigint, s2 bigint, bands array<bigint>"), "signatures")
    same = ["s1", "s2"]
    grouped = signed.where("s1 is not null").groupBy(*same).agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    reps = cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()), "representatives")

    members = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    thin = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK)
    met = members.join(thin, "bucket").join(reps.select("node", "copies", "bands"), "node")  # bands only for rows that meet another
    placed = met.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    laid = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))).select(
        "bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "band", "node", "copies", "bands")
    key = ["bucket", "p", "q"]
    kind = "bucket bigint, p int, q int, block int, band int, node bigint, copies bigint, bands array<bigint>"
    needed = cut_lineage(arrow_map(laid.repartition(*key).sortWithinPartitions(*key), _needed(bands), kind), "candidates")

    # the sets of the representatives that are needed anywhere, read from the texts again
    wanted = cut_lineage(needed.select("node").distinct().join(reps.select("node", *same, "least"), "node"), "wanted")
    size, bits = membership(wanted.select(F.xxhash64("least").alias("key")))
    hashed = source.select("text", F.pmod(F.xxhash64("id"), F.lit(size)).alias("slot"))
    sets = arrow_map(hashed, _sets(n, bits), "s1 bigint, s2 bigint, grams array<bigint>").join(wanted.select("node", *same), same)
    sets = sets.select("node", "grams").dropDuplicates(["node"])
    full = needed.join(sets, "node").select(*key, "block", "band", "node", "copies", "bands", "grams")
    verified = cut_lineage(
        arrow_map(full.repartition(*key).sortWithinPartitions(*key), _verify(bands, similarity), "node bigint, links bigint, peer bigint"), "links")

    roots = components(verified.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    linked = verified.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node")
    classes = linked.join(reps.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("class_id"))
    info = reps.select("node", *same, "least", "copies").join(linked, "node", "left").join(classes, "root", "left").select(
        *same, F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"))
    plain = signed.where("s1 is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    joined = signed.where("s1 is not null").select("id", *same).join(info, same).select("id", "class_id", "n_links", "n_copies")
    return joined.unionByName(plain).withColumnRenamed("id", id)
