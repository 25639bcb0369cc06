"""Merkle manifest of a table with a persistent tree whose versions copy paths.

A row is a leaf; the leaves of a group, in the order of their ids, form a tree in which ``ARITY``
consecutive nodes become their hash, and the roots of the groups form one more. The places of a
tree are cut into aligned blocks of ``ARITY**BLOCK_LEVELS`` leaves, each the subtree of one node, and a task holds
one block. Every tampered leaf makes a version of the block's tree: the nodes from the leaf to the
block's root are copied, all others are shared with the original. The roots of the blocks are the
leaves of the next tree up, which is cut into blocks in turn, so a group of any size is spread over
many tasks. There all rows of a block share one path, and each version goes on along it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.operators.numbering import join_null_safe, number_rows
from promptmill.session import cut_lineage, ship_package

ARITY = 3
BLOCK_LEVELS = 6  # a block has ARITY**BLOCK_LEVELS leaves


def digest(*parts: str) -> str:
    """SHA-256 of the parts, one behind the other, in lower-case hex."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Tree:
    """Tree over some leaves, ``levels`` high. Nodes are never changed: a version is the number of a root."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = levels
        self.digest: list[str] = []
        self.children: list[tuple[int, ...]] = []
        nodes = [self._add(d, ()) for d in leaves]
        for _ in range(levels):
            runs = [tuple(nodes[i: i + ARITY]) for i in range(0, len(nodes), ARITY)]
            nodes = [self._add(digest(*(self.digest[n] for n in run)), run) for run in runs]
        self.root = nodes[0]

    def _add(self, value: str, children: tuple[int, ...]) -> int:
        self.digest.append(value)
        self.children.append(children)
        return len(self.digest) - 1

    def _down(self, root: int, place: int) -> list[tuple[tuple[int, ...], int]]:
        """Children and the one taken at every node from the root to a leaf."""
        steps, node = [], root
        for level in reversed(range(self.levels)):
            turn, place = divmod(place, ARITY**level)
            steps.append((self.children[node], turn))
            node = self.children[node][turn]
        return steps

    def replace(self, root: int, place: int, value: str) -> int:
        """Root of a new version of ``root`` with another leaf; copies one node per level and shares the rest."""
        node = self._add(value, ())
        for children, turn in reversed(self._down(root, place)):
            new = (*children[:turn], node, *children[turn + 1:])
            node = self._add(digest(*(self.digest[n] for n in new)), new)
        return node

    def siblings(self, root: int, place: int) -> list[tuple[str, str]]:
        """What stands left and right of the path in each run, from the leaf up."""
        return [("".join(self.digest[n] for n in children[:turn]), "".join(self.digest[n] for n in children[turn + 1:]))
                for children, turn in reversed(self._down(root, place))]


def levels_of(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return sum((size > ARITY**k).cast("int") for k in range(39))


def field(value: Column) -> Column:
    """``-`` for null, else number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


_PATH = "array<struct<l:string,r:string>>"


def _ascend(nodes: DataFrame, group: list[str], height: int) -> DataFrame:
    """(group, ``_at``, ``_path``, ``_root``) of every node of the trees whose leaves are ``nodes``.

    ``nodes`` are (group, ``_at``, ``_digest``, ``_levels``): place, hash and height of the group's tree; blocks are ``height`` levels high.
    """
    ship_package(nodes.sparkSession)
    size = ARITY**height
    kinds = [f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in group]

    def climb(block: pa.Table) -> pa.Table:
        block = block.sort_by("_at")
        tree = Tree(block.column("_digest").to_pylist(), min(block.column("_levels")[0].as_py(), height))
        paths = [[{"l": a, "r": b} for a, b in tree.siblings(tree.root, place)] for place in range(len(block))]
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        return pa.table([*(block.column(c) for c in [*group, "_at", "_block"]), pa.array(paths, kind), pa.array([tree.digest[tree.root]] * len(block))],
                        [*group, "_at", "_block", "_path", "_root"])

    tall = nodes.agg(F.max("_levels")).first()[0] or 0
    placed = nodes.withColumn("_block", F.floor(F.col("_at") / size).cast("bigint"))
    schema = ", ".join([*kinds, "_at bigint", "_block bigint", f"_path {_PATH}", "_root string"])
    done = placed.groupBy(*group, "_block").applyInArrow(climb, schema)
    if tall <= height:
        return done.drop("_block")
    done = cut_lineage(done, "merkle-upper")
    left = placed.select(*group, "_block", "_levels").where(F.col("_at") % size == 0)
    heads = done.where(F.col("_at") % size == 0).select(*group, "_block", F.col("_root").alias("_digest"))
    above = join_null_safe(heads, left, [*group, "_block"]).select(
        *group, F.col("_block").alias("_at"), "_digest", F.greatest(F.col("_levels") - height, F.lit(0)).alias("_levels"))
    up = _ascend(above, group, height).select(*group, F.col("_at").alias("_block"), F.col("_path").alias("_more"), F.col("_root").alias("_top"))
    return join_null_safe(done, up, [*group, "_block"]).select(*group, "_at", F.concat("_path", "_more").alias("_path"), F.col("_top").alias("_root"))


def manifest(
    docs: DataFrame, fields: list[str], tampered: Column, altered: dict[str, Column], id: str = "doc_id", group: str = "source", block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Leaf, roots, proof and check of every row: ``id``, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of ``fields``. Where ``tampered`` holds, the fields named in ``altered`` take the values given there,
    and ``folded_root`` follows from the altered leaf and the original siblings. Leaves ascend by id, null first; rows that
    share an id by their hash, so repeated rows are leaves of their own. A null group is a group and comes first. A row that is
    the only one has an empty list of siblings, whose hash is that of no bytes. An empty table gives no rows.
    """
    size = ARITY**block_levels
    value = lambda c: F.col(c)
    leaf = F.sha2(F.concat(*[field(value(c)) for c in fields]), 256)
    other = F.sha2(F.concat(*[field(altered.get(c, value(c))) for c in fields]), 256)
    rows = docs.select(F.col(group).alias("_group"), F.col(id).alias("_id"), leaf.alias("_leaf"), F.when(tampered, other).alias("_other"))
    numbered = number_rows(rows, ["_id", "_leaf", "_other"], ["_group"], "_rn", "_n", hot_rows=0)
    at = F.col("_rn") - 1
    placed = numbered.select(
        "_group", "_id", "_leaf", "_other", at.alias("_at"), F.floor(at / size).cast("bigint").alias("_block"), levels_of(F.col("_n")).alias("_levels"))
    ship_package(docs.sparkSession)

    def versions(block: pa.Table) -> pa.Table:
        block = block.sort_by("_at")
        leaves = block.column("_leaf").to_pylist()
        tree = Tree(leaves, min(block.column("_levels")[0].as_py(), block_levels))
        original = tree.digest[tree.root]
        others = block.column("_other").to_pylist()
        version = [original if d is None else tree.digest[tree.replace(tree.root, place, d)] for place, d in enumerate(others)]
        beside = ["".join(a + b for a, b in tree.siblings(tree.root, place)) for place in range(len(block))]
        names = ["_group", "_id", "_leaf", "_at", "_block", "_levels"]
        return pa.table([*(block.column(c) for c in names), pa.array(beside), pa.array(version), pa.array([original] * len(block))],
                        [*names, "_beside", "_version", "_digest"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_group", "_id")}
    schema = f"_group {kinds['_group']}, _id {kinds['_id']}, _leaf string, _at bigint, _block bigint, _levels int, _beside string, _version string, _digest string"
    leaves = cut_lineage(placed.groupBy("_group", "_block").applyInArrow(versions, schema), "merkle-leaves")

    # one row per block: its path to the group's root, then that of the group to the root of all
    heads = leaves.where(F.col("_at") % size == 0).select(
        "_group", F.col("_block").alias("_at"), "_digest", F.greatest(F.col("_levels") - block_levels, F.lit(0)).alias("_levels"))
    blocks = cut_lineage(_ascend(heads, ["_group"], block_levels), "merkle-blocks")
    roots = blocks.where("_at = 0").select("_group", F.col("_root").alias("_digest"))
    ranked = cut_lineage(number_rows(roots, ["_group", "_digest"], (), "_rn", "_n"), "merkle-roots")
    tops = _ascend(ranked.select((F.col("_rn") - 1).alias("_at"), "_digest", levels_of(F.col("_n")).alias("_levels")), [], block_levels)
    named = ranked.select("_group", (F.col("_rn") - 1).alias("_at")).join(tops, "_at").select(
        "_group", F.col("_path").alias("_more"), F.col("_root").alias("_all"))
    above = join_null_safe(blocks, named, ["_group"]).select(
        "_group", F.col("_at").alias("_block"), F.col("_root").alias("subroot"), F.col("_all").alias("root"), F.concat("_path", "_more").alias("_path"))

    whole = join_null_safe(leaves, above, ["_group", "_block"])
    proof = F.concat("_beside", F.array_join(F.transform("_path", lambda x: F.concat(x["l"], x["r"])), ""))
    folded = F.aggregate("_path", F.col("_version"), lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))
    return whole.select(
        F.col("_id").alias(id), F.col("_leaf").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def even_checksum(id: str = "doc_id") -> Column:
    """Whether 2 divides the checksum of an id; never for a null one."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 2 == 0, F.lit(False))


def twin() -> str:
    """The manifest of ``documents`` in DuckDB's SQL."""
    value = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    head = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # each byte of the id, then eight shifts, in one fold
    steps = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: list_concat([cast(ord(c) as bigint)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"list_reduce(list_concat([4294967295], {steps}), lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end)"
    return f"""
    with recursive leaves as (
      select doc_id, source, sha256({head} || {value('text')}) as leaf, case when {crc} & 1 = 1 then sha256({head} || {value("replace(text, chr(10), '')")}) end as other,
        row_number() over (partition by source order by doc_id nulls first) - 1 as spot, count(*) over (partition by source) as n from documents),
    lower_tree(level, source, spot, h, n) as (
      select 0, source, spot, leaf, n from leaves
      union all
      select level + 1, source, spot // 3, sha256(string_agg(h, '' order by spot)), any_value((n + 2) // 3) from lower_tree where n > 1 group by level, source, spot // 3),
    tops as (
      select source, h, level as height, row_number() over (order by source nulls first) - 1 as spot, count(*) over () as n from lower_tree where n = 1),
    upper_tree(level, spot, h, n) as (
      select 0, spot, h, n from tops
      union all
      select level + 1, spot // 3, sha256(string_agg(h, '' order by spot)), any_value((n + 2) // 3) from upper_tree where n > 1 group by level, spot // 3),
    whole as (
      select l.*, t.h as subroot, t.height, t.spot as top_at, r.h as root, t.height + r.level as total
      from leaves l join tops t on l.source is not distinct from t.source cross join (select h, level from upper_tree where n = 1) r),
    beside as (
      select w.doc_id, t.level as step, t.spot, t.h, t.spot < w.spot // cast(pow(3, t.level) as bigint) as is_left
      from whole w join lower_tree t on t.source is not distinct from w.source and t.n > 1 and t.spot // 3 = w.spot // cast(pow(3, t.level + 1) as bigint)
      where t.spot <> w.spot // cast(pow(3, t.level) as bigint)
      union all
      select w.doc_id, w.height + t.level, t.spot, t.h, t.spot < w.top_at // cast(pow(3, t.level) as bigint)
      from whole w join upper_tree t on t.n > 1 and t.spot // 3 = w.top_at // cast(pow(3, t.level + 1) as bigint)
      where t.spot <> w.top_at // cast(pow(3, t.level) as bigint)),
    proofs as (select doc_id, sha256(string_agg(h, '' order by step, spot)) as proof_sha256 from beside group by doc_id),
    sides as (
      select doc_id, step, coalesce(string_agg(h, '' order by spot) filter (is_left), '') as l, coalesce(string_agg(h, '' order by spot) filter (not is_left), '') as r
      from beside group by doc_id, step),
    fold(doc_id, step, h, total) as (
      select doc_id, 0, coalesce(other, leaf), total from whole
      union all
      select f.doc_id, f.step + 1, sha256(coalesce(l, '') || h || coalesce(r, '')), total
      from fold f left join sides s on s.doc_id = f.doc_id and s.step = f.step where f.step < f.total)
    select w.doc_id, w.leaf, w.subroot, w.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = w.root as verified
    from whole w left join proofs p on p.doc_id = w.doc_id join fold f on f.doc_id = w.doc_id and f.step = w.total"""
