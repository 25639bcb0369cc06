"""Nearest neighbours by inner product with a vantage-point tree per shard.

The largest inner product is the smallest Euclidean distance once every candidate gets one more
coordinate that brings it to the greatest length of all, and every query a zero there. In that
space each shard builds a vantage-point tree: a node splits its points at the median distance
from its vantage point and keeps the range of distances on either side. A leaf is left out when
the triangle inequality, times ``factor``, shows that it holds nothing nearer than the
neighbours found so far: factor 1 is exact, a larger one is faster and may miss some.

The queries are a stated set. They meet the shards in blocks, and only the best of each pair of
a block and a shard are shuffled again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.tasks import ship_package

LEAF = 64
SHARD_ROWS = 8192
QUERY_ROWS = 4096
SLACK = 1e-7  # rounding of distances; a root of about zero is off by the root of the precision


class Tree:
    """Vantage-point tree over the rows of ``points``; leaves are runs of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.vantage: list[int] = []
        self.leaves: list[tuple[int, int, list[tuple[int, float, float]]]] = []
        stack: list[tuple[int, int, list]] = [(0, len(points), [])] if len(points) else []
        while stack:
            low, high, path = stack.pop()
            mine = self.order[low:high]
            part = points[mine]
            vantage = mine[np.argmax(((part - part.mean(0)) ** 2).sum(1))]  # a point at the rim
            distance = np.sqrt(((part - points[vantage]) ** 2).sum(1))
            by = np.argsort(distance, kind="stable")
            self.order[low:high], distance = mine[by], distance[by]
            node = len(self.vantage)
            self.vantage.append(int(vantage))
            if high - low <= leaf:
                self.leaves.append((low, high, [*path, (node, distance[0], distance[-1])]))
                continue
            half = (high - low) // 2
            stack.append((low + half, high, [*path, (node, distance[half], distance[-1])]))
            stack.append((low, low + half, [*path, (node, distance[0], distance[half - 1])]))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance of every query (row) to every leaf (column)."""
        at = self.points[self.vantage]
        far = np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (at**2).sum(1)[None, :] - 2 * queries @ at.T, 0))
        out = np.zeros((len(queries), len(self.leaves)))
        for i, (_, _, path) in enumerate(self.leaves):
            for node, low, high in path:
                d = far[:, node]
                np.maximum(out[:, i], np.maximum(low - d, d - high), out=out[:, i])
        return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component to the last in double precision."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total = total + a[:, d] * b[:, d]
    return total


def _all_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Every row of ``a`` with every row of ``b``, summed as in ``exact_products``."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        total = total + a[:, d, None] * b[None, :, d]
    return total


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, longest: float, factor: float = 1.0):
    """(query row, id, score) of the ``k`` nearest to each query among ``vectors``; a query's own id is left out.

    Of equal vectors only the ``k + 1`` smallest ids can ever be among the nearest; the others stay out of the tree.
    Queries for which more different vectors tie at the ``k``-th score than are kept are searched again, with exact
    scores and ties cut by id at every leaf.
    """
    order = np.lexsort([ids, *vectors.T[::-1]])
    ids, vectors = ids[order], vectors[order]
    fresh = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1)))
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    use = np.arange(len(ids)) - first <= k
    ids, vectors = ids[use], vectors[use]
    points = np.hstack([vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))[:, None]])
    wide = np.hstack([queries, np.zeros((len(queries), 1))])
    tree = Tree(points)
    least = tree.bounds(wide)
    keep = k + 1 + 8  # the query itself, and some that rounding may bring in
    best = np.full((len(queries), keep), -np.inf)
    found = np.full((len(queries), keep), -1)
    square = (queries**2).sum(1) + longest**2

    def visit(leaf: int, rows: np.ndarray) -> None:
        low, high, _ = tree.leaves[leaf]
        members = tree.order[low:high]
        product = queries[rows] @ vectors[members].T
        product[query_ids[rows][:, None] == ids[members][None, :]] = -np.inf
        both = np.hstack([best[rows], product])
        which = np.hstack([found[rows], np.broadcast_to(members, product.shape)])
        top = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
        best[rows], found[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(which, top, 1)

    nearest = least.argmin(1)
    for leaf in range(len(tree.leaves)):
        rows = np.flatnonzero(nearest == leaf)
        if len(rows):
            visit(leaf, rows)
    for leaf in np.argsort(least.mean(0), kind="stable"):
        reach = np.sqrt(np.maximum(square - 2 * best.min(1), 0))  # of the last one kept; infinite while there are too few
        rows = np.flatnonzero((least[:, leaf] * factor <= reach + SLACK * (1 + longest)) & (nearest != leaf))
        if len(rows):
            visit(leaf, rows)
    row, col = np.nonzero(found >= 0)
    at = found[row, col]
    real = np.isfinite(best[row, col])
    row, at = row[real], at[real]
    score = exact_products(queries[row], vectors[at])
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    # a vector that was cut may be as near as the k-th if the last one kept is, but for rounding
    kth = np.partition(best, keep - k, axis=1)[:, keep - k]
    rounding = 4 * (queries.shape[1] + 1) * np.finfo(float).eps * longest * np.sqrt((queries**2).sum(1))
    tied = np.isfinite(kth) & (best.min(1) >= kth - 2 * rounding)
    top = (rank < k) & ~tied[row]
    row, near, score = row[top], ids[at[top]], score[top]
    again = np.flatnonzero(tied)
    if len(again):
        reach = np.sqrt(np.maximum(square - 2 * (kth - rounding), 0))[again]
        high_score, low_id = np.full((len(again), k), -np.inf), np.full((len(again), k), np.iinfo(np.int64).max)
        for leaf, (low, high, _) in enumerate(tree.leaves):
            some = np.flatnonzero(least[again, leaf] * factor <= reach + SLACK * (1 + longest))
            if not len(some):
                continue
            members = tree.order[low:high]
            product = _all_products(queries[again[some]], vectors[members])
            product[query_ids[again[some]][:, None] == ids[members][None, :]] = -np.inf
            both = np.hstack([high_score[some], product])
            which = np.hstack([low_id[some], np.broadcast_to(ids[members], product.shape)])
            order = np.lexsort((which, -both), axis=1)[:, :k]
            high_score[some], low_id[some] = np.take_along_axis(both, order, 1), np.take_along_axis(which, order, 1)
        of, col = np.nonzero(np.isfinite(high_score))
        row, near, score = np.concatenate([row, again[of]]), np.concatenate([near, low_id[of, col]]), np.concatenate([score, high_score[of, col]])
    return row, near, score


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(table: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row for which ``is_query`` holds its ``k`` nearest other rows.

    Equal scores are ranked by id. Vectors of another length are no candidates; rows without an id
    and vectors that are not ``usable`` take no part. Rows that repeat an id count once, with the
    smallest of its vectors.
    """
    ship_package(table.sparkSession)
    v = F.col("v")
    clean = table.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where(
        F.col("id").isNotNull() & usable(v)).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    clean = clean.withColumn("dim", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = clean.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("nq"), F.sqrt(F.max(square)).alias("longest")).collect()
    if not sizes:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size = {r["dim"]: (-(-r["n"] // SHARD_ROWS), max(1, -(-r["nq"] // QUERY_ROWS)), r["longest"] * (1 + 1e-12)) for r in sizes}

    def per_dim(place: int) -> Column:
        return F.element_at(F.create_map(*[x for d, s in size.items() for x in (F.lit(d), F.lit(s[place]))]), F.col("dim"))

    def spread(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))

    shards, blocks = per_dim(0), per_dim(1)
    spot = F.xxhash64("id")
    candidates = clean.select("dim", F.pmod(spot, shards).cast("int").alias("shard"), spread(blocks).alias("block"), "id", "v")
    queries = clean.where("q").select("dim", spread(shards).alias("shard"), F.pmod(F.shiftright(spot, 20), blocks).cast("int").alias("block"), "id", "v")
    longest = {d: s[2] for d, s in size.items()}
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(some) or not len(asked):
            return kind.empty_table()
        dim = some.column("dim")[0].as_py()
        (ids, vectors), (query_ids, wanted) = (
            (t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)) for t in (some, asked))
        row, near, score = search(ids, vectors, query_ids, wanted, k, longest[dim], factor)
        return pa.Table.from_arrays([pa.array(query_ids[row]), pa.array(near), pa.array(score)], schema=kind)

    keys = ["dim", "shard", "block"]
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
