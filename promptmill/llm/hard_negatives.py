"""Hard negatives by an STR-packed R-tree over vectors of whole numbers.

The rows are packed into tiles by sort-tile-recursive slicing: by label, then again and again by
the coordinate that varies most in a slice, with cuts taken from a sample of at most ``SAMPLE`` rows; every row is then put into
its tile. A tile is the root of a small R-tree whose leaves are packed the same way. The bounding
box of a node gives, coordinate by coordinate, the least and greatest inner product that an anchor
can have with anything inside, and the labels in it.

A search asks for the ``k`` highest scores within a window, of rows with the anchor's label (the
positives) or another one (the negatives). Its queue is best first: of the open boxes the one with the
greatest possible score in the window comes next, and a box goes when its interval lies outside
the window or strictly below the ``k``-th score found. Anchors come in blocks of ``BLOCK``. A block first meets the tile that most
of its anchors would open first, and then only the tiles that can still hold something for one of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.tasks import arrow_map, ship_package
from promptmill.session import cut_lineage

K = 5
LEAF = 64
TILE_ROWS = 8192
BLOCK = 1024  # anchors that meet a tile together
MAX_TILES = 4096  # the boxes of all tiles go to every task: at most BOX_VALUES numbers
BOX_VALUES = 1 << 20
SAMPLE = 4096
LOWEST = -(1 << 62)
HIGHEST = 1 << 62


@dataclass
class Slices:
    """Cuts of one axis and what follows in each slice; tiles are numbered in the order of the slices."""

    axis: int = -1
    cuts: list = field(default_factory=list)
    parts: list[Slices] = field(default_factory=list)
    first: int = 0
    tiles: int = 1


def str_slices(points: np.ndarray, tiles: int, by_label: bool = True, first: int = 0) -> Slices:
    """Sort-tile-recursive: slices of equal share along the label (column 0), then halves along what varies most in each slice."""
    if tiles <= 1 or not len(points):
        return Slices(first=first)
    axis = 0 if by_label else int(points[:, 1:].astype(np.float64).var(0).argmax()) + 1 if points.shape[1] > 1 else 0
    n = min(tiles, max(2, round(tiles**0.5))) if by_label else 2
    column = np.sort(points[:, axis])
    cuts = sorted({column[len(column) * i // n] for i in range(1, n)} - {column[0]})
    if not cuts and not by_label:  # nothing varies
        return Slices(first=first)
    slot = np.searchsorted(cuts, points[:, axis], "right")
    out = Slices(axis, cuts, first=first, tiles=0)
    for i in range(len(cuts) + 1):
        mine = points[slot == i]
        part = str_slices(mine, max(1, round(tiles * len(mine) / len(points))), False, first + out.tiles)
        out.parts.append(part)
        out.tiles += part.tiles
    return out


def tile_of(slices: Slices, points: np.ndarray) -> np.ndarray:
    """Tile of every row of ``points``."""
    if not slices.parts:
        return np.full(len(points), slices.first, np.int64)
    slot = np.searchsorted(slices.cuts, points[:, slices.axis], "right")
    out = np.empty(len(points), np.int64)
    for i, part in enumerate(slices.parts):
        mine = slot == i
        out[mine] = tile_of(part, points[mine])
    return out


@dataclass
class Boxes:
    """Bounding boxes and labels (least, greatest) of some nodes, one per row."""

    low: np.ndarray
    high: np.ndarray
    label: np.ndarray

    def reach(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of every vector (row) with anything in every box (column)."""
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def fits(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Whether a box (column) may hold a row with the label of an anchor (row), or one with another label."""
        low, high, own = self.label[:, 0][None, :], self.label[:, 1][None, :], labels[:, None]
        return (low <= own) & (own <= high) if same else ~((low == own) & (high == own))


@dataclass
class Asked:
    """Searches: the anchor of each (a row of ``vectors``), its window and the least score that can still matter."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


def exact(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers as floats where all inner products stay exact in them, else as 64-bit integers."""
    most = int(np.abs(vectors).max(initial=0)) ** 2 * max(vectors.shape[1], 1)
    if most >= 1 << 62:
        raise ValueError("components are too large for 64-bit scores")
    return vectors.astype(np.float64 if most < 1 << 52 else np.int64)


def packed(labels: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, Boxes]:
    """Leaves of about ``LEAF`` rows: the order of the rows, where each leaf starts, and their boxes."""
    points = np.column_stack([labels, vectors])  # for slicing; labels may lose digits here
    leaf = tile_of(str_slices(points, -(-len(points) // LEAF)), points)
    order = np.argsort(leaf, kind="stable")
    start = np.concatenate(([0], np.flatnonzero(np.diff(leaf[order])) + 1))
    inside, own = vectors[order], labels[order]
    bounds = np.column_stack([np.minimum.reduceat(own, start), np.maximum.reduceat(own, start)])
    return order, start, Boxes(np.minimum.reduceat(inside, start), np.maximum.reduceat(inside, start), bounds)


def search(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, asked: Asked, same: bool, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search, id, score) of the ``k`` best rows of a tile for every search, ties by id; the anchor itself is left out."""
    both = exact(np.concatenate([vectors, asked.vectors]))
    vectors, wanted = both[: len(vectors)], both[len(vectors):]
    order, start, boxes = packed(labels, vectors)
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    end = np.append(start[1:], len(ids))
    least, most = boxes.reach(wanted)
    n = len(asked.ids)
    score, found = np.full((n, k), LOWEST), np.full((n, k), HIGHEST)
    floor = np.maximum(asked.low, asked.least)
    top = np.minimum(most, asked.high[:, None])
    top[~boxes.fits(asked.labels, same) | (least > asked.high[:, None])] = LOWEST
    while True:
        # strictly below the k-th score: an equal one may have a smaller id
        top[top < np.maximum(floor, score[:, -1])[:, None]] = LOWEST
        pick = top.argmax(1)
        live = np.flatnonzero(top[np.arange(n), pick] > LOWEST)
        if not len(live):
            break
        for leaf in np.unique(pick[live]):
            mine = live[pick[live] == leaf]
            rows = slice(start[leaf], end[leaf])
            got = (wanted[mine] @ vectors[rows].T).astype(np.int64)
            fits = (labels[rows][None, :] == asked.labels[mine][:, None]) == same
            fits &= (ids[rows][None, :] != asked.ids[mine][:, None]) & (got >= asked.low[mine][:, None]) & (got <= asked.high[mine][:, None])
            all_scores = np.hstack([score[mine], np.where(fits, got, LOWEST)])
            all_ids = np.hstack([found[mine], np.where(fits, ids[rows][None, :], HIGHEST)])
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            score[mine], found[mine] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
            top[mine, leaf] = LOWEST
    row, col = np.nonzero(score > LOWEST)
    return row, found[row, col], score[row, col]


def _matrix(table: pa.Table | pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    values = table.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim)


def _asked(table: pa.Table, dim: int) -> Asked:
    column = lambda c: table.column(c).to_numpy()
    return Asked(column("id"), column("label"), _matrix(table, "v", dim), column("low"), column("high"), column("least"))


class Index:
    """Rows of one length in their tiles, the boxes of the tiles, and the anchors in blocks of neighbouring tiles."""

    def __init__(self, rows: DataFrame, dim: int, n: int):
        self.dim = dim
        spark = rows.sparkSession
        wanted = min(-(-n // TILE_ROWS), MAX_TILES, max(1, BOX_VALUES // (2 * dim + 2)))
        slices = Slices()
        if wanted > 1:
            some = rows.select("label", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
            points = np.column_stack([some.column("label").to_numpy(), _matrix(some, "v", dim)])
            slices = str_slices(points, wanted)

        def place(batches):
            for batch in batches:
                points = np.column_stack([batch.column("label").to_numpy(), _matrix(batch, "v", dim)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile_of(slices, points))], [*batch.schema.names, "tile"])

        kind = "id bigint, label bigint, v array<bigint>, anchor boolean, tile bigint"
        placed = cut_lineage(arrow_map(rows.select("id", "label", "v", "anchor"), place, kind), "tiles")
        found = placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).orderBy("tile").collect()
        self.tiles = np.array([r["tile"] for r in found])  # as many as there are tiles at most
        self.boxes = spark.sparkContext.broadcast(self._boxes(placed))
        self.parts = {r["tile"]: -(-r["n"] // TILE_ROWS) for r in found}
        blocks, last, held = [], 0, 0
        for r in found:
            if held and held + r["anchors"] > BLOCK:
                last, held = last + 1, 0
            mine = max(1, -(-r["anchors"] // BLOCK))
            blocks.append((r["tile"], self.parts[r["tile"]], last, mine))
            last, held = (last, held + r["anchors"]) if mine == 1 else (last + mine, 0)
        # a row per tile
        self.stats = F.broadcast(spark.createDataFrame(blocks, "tile bigint, parts bigint, first bigint, blocks bigint"))
        spot = F.xxhash64("id")
        self.rows = placed.join(self.stats, "tile").select("tile", F.pmod(spot, "parts").alias("part"), "id", "label", "v")
        self.anchors = placed.where("anchor").join(self.stats, "tile").select((F.col("first") + F.pmod(spot, "blocks")).alias("block"), "id", "label", "v")

    def _boxes(self, placed: DataFrame) -> Boxes:
        """Least and greatest labels and coordinates of every tile, combined in each task first."""
        dim = self.dim
        kind = pa.schema([("tile", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])

        def bound(batches):
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                points = np.column_stack([batch.column("label").to_numpy(), _matrix(batch, "v", dim)])
                tile = batch.column("tile").to_numpy()
                for t in np.unique(tile).tolist():
                    some = points[tile == t]
                    low, high = some.min(0), some.max(0)
                    if t in held:
                        low, high = np.minimum(low, held[t][0]), np.maximum(high, held[t][1])
                    held[t] = low, high
            for t, (low, high) in held.items():
                yield pa.RecordBatch.from_pylist([{"tile": t, "low": low.tolist(), "high": high.tolist()}], kind)

        def merge(table: pa.Table) -> pa.Table:
            low, high = _matrix(table, "low", dim + 1).min(0), _matrix(table, "high", dim + 1).max(0)
            return pa.Table.from_pylist([{"tile": table.column("tile")[0].as_py(), "low": low.tolist(), "high": high.tolist()}], kind)

        schema = "tile bigint, low array<bigint>, high array<bigint>"
        by_task = arrow_map(placed.select("tile", "label", "v"), bound, schema)
        all_of = by_task.groupBy("tile").applyInArrow(merge, schema).orderBy("tile").toArrow()  # at most BOX_VALUES numbers
        low, high = _matrix(all_of, "low", dim + 1), _matrix(all_of, "high", dim + 1)
        return Boxes(low[:, 1:], high[:, 1:], np.column_stack([low[:, 0], high[:, 0]]))

    def _pairs(self, asked: DataFrame, same: bool, first: bool) -> DataFrame:
        """(block, tile): the tile that most searches of a block open first, or all others that can still hold something for one."""
        boxes, tiles, dim = self.boxes, self.tiles, self.dim

        def run(table: pa.Table) -> pa.Table:
            a, b = _asked(table, dim), boxes.value
            both = exact(np.concatenate([a.vectors, b.low, b.high]))
            b = Boxes(both[len(a.ids): len(a.ids) + len(b.low)], both[len(a.ids) + len(b.low):], b.label)
            low, high = b.reach(both[: len(a.ids)])
            top = np.minimum(high, a.high[:, None])
            top[~b.fits(a.labels, same) | (low > a.high[:, None]) | (top < np.maximum(a.low, a.least)[:, None])] = LOWEST
            if first:
                pick = top.argmax(1)[top.max(1) > LOWEST]
                take = [int(np.bincount(pick).argmax())] if len(pick) else []
            else:
                done = np.searchsorted(tiles, table.column("done")[0].as_py()) if table.column("done")[0].is_valid else -1
                take = [i for i in np.flatnonzero((top > LOWEST).any(0)).tolist() if i != done]
            return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(take), pa.int64()), "tile": pa.array(tiles[take], pa.int64())})

        return cut_lineage(asked.groupBy("block").applyInArrow(run, "block bigint, tile bigint"), "visits")

    def _meet(self, asked: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, goal, found, score): the best rows of each visited tile, part by part, for the searches of the block."""
        dim = self.dim
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
        visitors = asked.join(pairs, "block").join(self.stats, "tile").select("block", "tile", part, "id", "label", "v", "goal", "low", "high", "least")
        visited = self.rows.join(pairs, "tile")
        # names of their own for the two sides, which come from the same tables
        visitors, visited = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (visitors, visited))
        kind = pa.schema([("id", pa.int64()), ("goal", pa.int64()), ("found", pa.int64()), ("score", pa.int64())])

        def run(some: pa.Table, table: pa.Table) -> pa.Table:
            if not len(some) or not len(table):
                return kind.empty_table()
            a = _asked(table, dim)
            row, found, score = search(some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some, "v", dim), a, same, k)
            return pa.table([a.ids[row], table.column("goal").to_numpy()[row], found, score], schema=kind)

        keys = ["block", "tile", "part"]
        met = visited.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(run, "id bigint, goal bigint, found bigint, score bigint")
        return cut_lineage(met, "met")

    def best(self, searches: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, goal, rank, found, score): the ``k`` best rows for every search (block, id, label, v, goal, low, high)."""
        order = Window.partitionBy("id", "goal").orderBy(F.desc("score"), F.asc("found"))
        first = searches.withColumn("least", F.lit(LOWEST))
        pairs = self._pairs(first, same, True)
        near = self._meet(first, pairs, same, k)
        kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("id", "goal", F.col("score").alias("least"))
        again = searches.join(kth, ["id", "goal"], "left").withColumn("least", F.coalesce("least", F.lit(LOWEST)))
        again = again.join(pairs.select("block", F.col("tile").alias("done")), "block", "left")
        rest = self._meet(again, self._pairs(again, same, False), same, k)
        return near.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "goal", "rank", "found", "score")


def _divided(value: Column) -> Column:
    """A hundredth, rounded down, without going through floating point."""
    return F.call_function("div", value - F.pmod(value, F.lit(100)), F.lit(100)).cast("bigint")


def mine(
    table: DataFrame, is_anchor: Column, k: int = K, low: int = 80, high: int = 100, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of every row for which ``is_anchor`` holds.

    Components become ``floor(scale * x)``; a score is the inner product of two rows. The positives of an anchor are its ``k``
    best other rows with its label; for each, the ``k`` best rows with another label and ``low * positive <= 100 * negative <= high * positive``
    are its negatives. Higher scores come first, equal ones by id.

    Rows with a null id, label or vector, or with a component that is null or not finite take no part, nor do vectors of another length
    than the anchor's for that anchor. Rows that repeat an id count once, with the smallest label and vector. An anchor without
    positives, or a positive without negatives, gives no rows; an empty table none. Components whose scores do not fit 64 bits are a ValueError.
    """
    spark = table.sparkSession
    ship_package(spark)
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = table.select(
        F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"), is_anchor.alias("anchor")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    whole = kept.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("v"), "anchor")
    once = whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("anchor").alias("anchor"))
    clean = cut_lineage(once.select("id", "r.label", "r.v", F.coalesce("anchor", F.lit(False)).alias("anchor")).withColumn("dim", F.size("v")), "vectors")
    sizes = {r["dim"]: r["n"] for r in clean.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for dim, n in sizes.items():  # lengths of vectors are few
        tree = Index(clean.where(F.col("dim") == dim).drop("dim"), dim, n)
        ask = tree.anchors.select("block", "id", "label", "v", F.lit(0).cast("bigint").alias("goal"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
        positives = cut_lineage(tree.best(ask, True, k), "positives")
        least, most = (F.expr(f"{sign}score * {share}") for sign, share in (("-", low), ("", high)))
        window = positives.select("id", F.col("found").alias("goal"), (-_divided(least)).alias("low"), _divided(most).alias("high"))
        negatives = tree.best(tree.anchors.select("block", "id", "label", "v").join(window, "id"), False, k)
        scored = negatives.join(positives.select("id", F.col("found").alias("goal"), F.col("score").alias("positive_score")), ["id", "goal"])
        out = out.unionByName(scored.select(
            F.col("id").alias("anchor_id"), F.col("goal").alias("positive_id"), "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).select(*names))
    return out


def twin() -> str:
    """The hard negatives of ``embeddings`` in DuckDB's SQL."""
    return """
    with e as (
      select vec_id as id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
      from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as (
      select a.id as anchor_id, c.id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score
      from e a join e c on a.id <> c.id and len(a.v) = len(c.v) where a.id % 100 = 0),
    pos as (
      select anchor_id, id as positive_id, score as positive_score from (
        select *, row_number() over (partition by anchor_id order by score desc, id) as n from p where same) x where n <= 5),
    neg as (
      select pos.*, p.id as negative_id, p.score as negative_score,
        cast(row_number() over (partition by pos.anchor_id, positive_id order by p.score desc, p.id) as integer) as rank
      from pos join p on p.anchor_id = pos.anchor_id and not p.same and 80 * positive_score <= 100 * p.score and 100 * p.score <= 100 * positive_score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from neg where rank <= 5"""
