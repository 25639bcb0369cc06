"""Operators against brute force, also under skew and in repeated use."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from promptmill.operators import audit, claims, events, numbering, results, upserts
from promptmill.operators.joins import join_hot
from promptmill.sources import jsonl, objects

NOW = "2026-01-01 00:00:00"


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 'hot' holds two thirds of the rows; order values repeat, ids break the ties."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.66 else f"g{rng.randrange(40)}", rng.randrange(50), i, f"t{i}") for i in range(4000)]
    return rows, spark.createDataFrame(rows, "g string, o int, id int, text string").repartition(7)


def expected_numbers(rows):
    out = {}
    for _, grp in groupby(sorted(rows), key=lambda r: r[0]):
        for n, r in enumerate(grp, 1):
            out[r[2]] = n
    return out


def test_numbers_per_group(skewed):
    rows, df = skewed
    got = {r.id: r.rn for r in numbering.number_rows(df, ["o", "id"], ["g"]).collect()}
    assert got == expected_numbers(rows)


def test_fixed_groups(skewed):
    rows, df = skewed
    got = {r.id: (r.batch_no, r.pos) for r in numbering.fixed_groups(df, 10, ["o", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert got == {r[2]: (i // 10, i % 10 + 1) for i, r in enumerate(order)}


def test_ordered_concat(skewed):
    rows, df = skewed
    chunks = numbering.ordered_concat(df, ["g"], ["o", "id"], "text", "--", chunk_rows=100).orderBy("g", "chunk_no").collect()
    joined = {g: "".join(c.chunk for c in cs) for g, cs in groupby(chunks, key=lambda c: c.g)}
    want = {g: "--".join(r[3] for r in grp) for g, grp in groupby(sorted(rows), key=lambda r: r[0])}
    assert joined == want and max(c.chunk.count("t") for c in chunks) <= 100


def test_numbering_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, o int")
    assert numbering.number_rows(empty, ["o"], ["g"]).count() == 0 and numbering.fixed_groups(empty, 10, ["o"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [0, 10**6])
def test_hot_join(skewed, spark, how, limit):
    _, df = skewed
    small = spark.createDataFrame([("hot", 1), ("g3", 2), ("none", 3)], "g string, v int")
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(join_hot(df, small, ["g"], how, broadcast_rows=limit).select(*df.join(small, "g", how).columns)) == key(df.join(small, "g", how))


def test_upserts_are_idempotent(spark):
    have = spark.createDataFrame([("b", "r1", "old", "{}", "x")], "batch_fk string, request_fk string, created_at string, metadata string, content string")
    new = spark.createDataFrame([("b", "r1", None, "a", 1), ("b", "r1", "{1}", None, 2), ("b", "r2", None, "c", 3)], "batch_fk string, request_fk string, metadata string, content string, line_no int")
    once = results.upsert_results(have, new, ["line_no"], F.lit("now"))
    twice = results.upsert_results(once, new, ["line_no"], F.lit("later"))
    want = [("b", "r1", "old", "{1}", ""), ("b", "r2", "now", "null", "c")]
    for df in (once, twice):
        assert sorted(tuple(r) for r in df.select("batch_fk", "request_fk", "created_at", "metadata", "content").collect()) == want
    rows = spark.createDataFrame([("b",), ("c",), ("c",)], "batch_fk string")
    base = have.select("batch_fk")
    first = upserts.insert_if_absent(base, rows, ["batch_fk"])
    assert sorted(r[0] for r in upserts.insert_if_absent(first, rows, ["batch_fk"]).collect()) == ["b", "c"]


@pytest.fixture(scope="module")
def requests(spark):
    rows = [("r1", "entered", "t1"), ("r2", "entered", "t2"), ("r3", "submitted", "t3"), ("r4", "completed", None)]
    return spark.createDataFrame(rows, "request_id string, state string, submit_claim_token string").select(
        "*", F.lit("w").alias("submit_claimed_by"), F.lit(NOW).cast("timestamp_ntz").alias("submit_claimed_until"), F.lit("2025-01-01").cast("timestamp_ntz").alias("updated_at"))


def states(df):
    return {r.request_id: r.state for r in df.collect()}


def test_stale_tokens_change_nothing(spark, requests):
    tokens = spark.createDataFrame([("r1", "t1"), ("r2", "stale"), ("r3", "t3"), ("r4", None)], "request_id string, submit_claim_token string")
    out = claims.transition(requests, tokens, "submitted", NOW, from_state="entered")
    assert states(out) == {"r1": "submitted", "r2": "entered", "r3": "submitted", "r4": "completed"}
    rows = {r.request_id: r for r in out.collect()}
    assert rows["r1"].submit_claim_token is None and rows["r1"].submit_claimed_until is None and str(rows["r1"].updated_at) == NOW
    assert rows["r3"].submit_claim_token == "t3" and str(rows["r3"].updated_at).startswith("2025")
    freed = claims.release(requests, tokens, "request_id", "submit", NOW)
    assert {r.request_id for r in freed.where("submit_claim_token is null").collect()} == {"r1", "r3", "r4"}
    left = claims.delete_claimed(requests, tokens, "request_id", "submit")
    assert {r.request_id for r in left.collect()} == {"r2", "r4"}


def test_terminal_states_are_final(spark):
    rows = [("a", 1, "entered"), ("a", 2, "submitted"), ("a", 4, "completed"), ("a", 5, "submitted"), ("b", 1, "entered"), ("b", 3, "submitted"), ("c", 9, "cancelled"), ("c", 10, "completed")]
    df = spark.createDataFrame([(i, r, s, f"2026-01-{t:02d} 00:00:00") for i, (r, t, s) in enumerate(rows)], "event_id int, request_id string, state string, occurred_at string")
    assert states(events.request_states(df)) == {"a": "completed", "b": "submitted", "c": "cancelled"}
    assert {r.request_id: r.event_id for r in events.latest_event(df, "request_id").collect()} == {"a": 3, "b": 5, "c": 7}


def test_line_classes(spark):
    lines = ['{"custom_id":"a","output_text":"x"}', '{"custom_id":"b"}', "bad", '{"x":1}', '{"custom_id":5}', "bad"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    known = spark.createDataFrame([("b",), ("b",)], "custom_id string")
    got = {r.n: r.line_class for r in results.classify_lines(jsonl.with_main_text(df), known).collect()}
    assert got == {0: "new", 1: "skipped", 2: "invalid", 3: "no_id", 4: "no_id", 5: "invalid"}
    good, bad = results.split_good_bad(jsonl.with_main_text(df))
    assert (good.count(), bad.count()) == (0, 6)  # "a" is no request id


def test_cascade_by_batch(spark):
    keys = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    tables = {"batches": keys("uid", "1", "2"), "fetch_outbox": keys("batch_fk", "1", "2", "2"), "batch_events": keys("batch_fk", "2"), "batch_requests": keys("batch_fk", "1", "2"), "request_results": keys("batch_fk", "2")}
    left = audit.cascade_delete(tables, batches=keys("uid", "2"))
    assert {n: d.count() for n, d in left.items()} == {"batches": 1, "fetch_outbox": 1, "batch_events": 0, "batch_requests": 1, "request_results": 0}
    odd = audit.state_domain_check(keys("state", "entered", "gone", None), "state").collect()
    assert {(r.value, r.n) for r in odd} == {("gone", 1), (None, 1)}


def test_prefix_listing(spark):
    obj = spark.createDataFrame([("a/b/1",), ("a/b/2",), ("a/c",), ("z",)], "key string")
    pre = spark.createDataFrame([("a/",), ("a/b/",), ("",), ("zz",)], "prefix string")
    got = sorted((r.prefix, r.key) for r in objects.list_by_prefix(obj, pre).collect())
    assert got == sorted((p, k) for p in ("a/", "a/b/", "", "zz") for k in ("a/b/1", "a/b/2", "a/c", "z") if k.startswith(p))


def test_prefix_listing_sweeps_each_object_once(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice("ab/\u00e9\U0001f600") for _ in range(rng.randint(0, 7))) for _ in range(600)] + ["a/b"] * 300 + [None]
    cuts = [k[: rng.randint(0, len(k))] for k in keys[:150] if k] + ["", "a", "a", None, "b" * 60]
    obj = spark.createDataFrame([(k, i, {"n": i}, "own") for i, k in enumerate(keys)], "key string, id int, tags map<string,int>, prefix string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for wanted in (cuts, ["a/"], [None], ["zz"]):
            got = objects.list_by_prefix(obj, spark.createDataFrame([(p,) for p in wanted], "prefix string"))
            assert got.columns == ["prefix", "key", "id", "tags"]
            assert sorted((r.prefix, r.id) for r in got.collect()) == sorted(
                (p, i) for p in {*wanted} - {None} for i, k in enumerate(keys) if k is not None and k.startswith(p))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert objects.list_by_prefix(obj.where("false"), spark.createDataFrame([("a",)], "prefix string")).count() == 0
    assert objects.list_by_prefix(obj, spark.createDataFrame([], "prefix string")).count() == 0


def test_set_if_null_takes_the_first_of_several(spark):
    rows = spark.createDataFrame([("a", None), ("b", "old"), ("c", None)], "k string, v string")
    new = spark.createDataFrame([("a", "z", 1), ("a", "y", 2), ("a", None, 0), ("b", "x", 1), ("c", None, 1)], "k string, w string, at int")
    fill = lambda order: {r.k: r.v for r in upserts.set_if_null(rows, new, "k", "v", "w", F.lit(True), order).collect()}
    assert fill(["at"]) == {"a": "z", "b": "old", "c": None}
    assert fill([]) == {"a": "y", "b": "old", "c": None}


def test_files(spark, tmp_path):
    for name in ("q1.json", "batch_summary_1.json", "page.html"):
        (tmp_path / name).write_text("{}")
    assert {r.custom_id for r in objects.read_existing_ids(spark, str(tmp_path)).collect()} == {"q1", "batch_summary_1"}
    assert bytes(objects.read_files(spark, [str(tmp_path / "q1.json")]).first().content) == b"{}"
    (tmp_path / "r.jsonl").write_text('{"a":1}\n\nbad\n')
    assert jsonl.read_lines(spark, str(tmp_path / "r.jsonl")).count() == 2


def test_decode_base64(spark):
    df = spark.createDataFrame([(1, "aGVs\nbG8="), (2, "a"), (3, "")], "k int, b string")
    got = {r.k: r.content for r in objects.decode_base64(df, "b").collect()}
    assert bytes(got[1]) == b"hello" and got[2] is None and bytes(got[3]) == b""


def test_null_groups_are_numbered(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), (None, 1, "r"), (None, 2, "s"), ("b", None, "t")], "g string, o int, text string")
    got = {(r.g, r.o): (r.rn, r.n) for r in numbering.number_rows(df, ["o"], ["g"], size="n").collect()}
    assert got == {("a", 1): (1, 2), ("a", 2): (2, 2), (None, 1): (1, 2), (None, 2): (2, 2), ("b", None): (1, 1)}
    chunks = {r.g: r.chunk for r in numbering.ordered_concat(df, ["g"], ["o"], "text", "-").collect()}
    assert chunks == {"a": "p-q", None: "r-s", "b": "t"}


@pytest.mark.parametrize("hot_rows", [0, 2, 500, numbering.HOT_ROWS])
def test_ties_number_every_row_once(spark, skewed, hot_rows):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 2, "z"), (None, None, "n"), (None, None, "n")]
    df = spark.createDataFrame(rows, "g string, o int, text string").repartition(3)
    got = [(r.g, r.o, r.text, r.rn, r.n) for r in numbering.number_rows(df, ["o"], ["g"], size="n", hot_rows=hot_rows).collect()]
    assert sorted(map(repr, (r[:3] for r in got))) == sorted(map(repr, rows))
    for g, n in (("a", 3), ("b", 1), (None, 2)):
        assert sorted(r[3] for r in got if r[0] == g) == [*range(1, n + 1)] and {r[4] for r in got if r[0] == g} == {n}
    data, df = skewed  # the order values repeat; both ways break ties alike
    numbers = {r.id: (r.rn, r.n) for r in numbering.number_rows(df, ["o"], ["g"], size="n", hot_rows=hot_rows).collect()}
    plain = {r.id: (r.rn, r.n) for r in numbering.number_rows(df, ["o"], ["g"], size="n").collect()}
    assert len(numbers) == len(data) and numbers == plain


def test_ties_in_what_is_built_on_numbers(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z"), ("b", 1, "z")]
    df = spark.createDataFrame(rows, "g string, o int, text string").repartition(3)
    joined = {r.g: sorted(r.chunk.split("|")) for r in numbering.ordered_concat(df, ["g"], ["o"], "text", "|").collect()}
    assert joined == {"a": ["x", "y"], "b": ["z", "z"]}
    places = sorted((r.batch_no, r.pos) for r in numbering.fixed_groups(df, 3, ["o"]).collect())
    assert places == [(0, 1), (0, 2), (0, 3), (1, 1)]
    assert sorted((r.g, r.item_index) for r in results.item_index(df, "g", ["o"]).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    parts = results.extracted_document(df, ["g"], ["o"], "text").where("part_no = 1").collect()
    assert {r.g: sorted(r.part.split(results.TEXT_SEPARATOR)) for r in parts} == {"a": ["x", "y"], "b": ["z", "z"]}


def test_small_groups_are_numbered_in_one_exchange(skewed):
    numbered = numbering.number_rows(skewed[1], ["o", "id"], ["g"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "Join" not in plan


def test_uniqueness_is_counted_in_tasks_of_bounded_keys(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("a"), F.floor(F.col("id") / 2).alias("b"))
    tables = {"t": rows, "none": rows.limit(0)}
    got = audit.uniqueness_audit(tables, {"t": [("a",), ("b",), ("a", "b")], "none": [("a",)]}, task_rows=100).collect()
    assert {(r.table_name, r.key_columns): (r.n_rows, r.n_keys, r.n_repeated) for r in got} == {
        ("t", "a"): (3000, 1002, 2), ("t", "b"): (3000, 1500, 1500), ("t", "a,b"): (3000, 3000, 0), ("none", "a"): (0, 0, 0)}
    dealt = audit._per_key(rows.select("b"), 100).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("keys")).collect()
    assert len(dealt) >= 20 and max(r["keys"] for r in dealt) <= 150
