"""The file steps and a whole round trip with a provider that echoes."""

import json

from pyspark.sql import functions as F

from promptmill.operators import claims, events, results
from promptmill.plans import commands, production
from promptmill.sources import corpus, jsonl

NOW = "2026-01-02 03:04:05"
UID = "00000000-0000-4000-8000-00000000000"


def test_load(spark):
    runs = spark.createDataFrame([(1, "doc", "x: no\n\n5: A\n\n6: B"), (2, "d2", "none")], "run int, document string, prompts string")
    loaded = commands.load_requests(runs, "run", NOW, "m", prefix="<", postfix=">")
    got = loaded.lines.orderBy("index").collect()
    assert [(r.run, r["index"], r.custom_id) for r in got] == [(1, 1, "q_260102_030405_0001"), (1, 2, "q_260102_030405_0002")]
    body = json.loads(got[1].line)["body"]
    assert body["input"][0]["content"][0]["text"] == "<doc\n\n\nUse these project details as the authoritative context for your responses.\n>"
    assert body["input"][1]["content"][0]["text"] == 'Generate a first version for item 6, "B"'
    assert [r.run for r in loaded.rejected.collect()] == [2]
    fixed = commands.load_requests(runs, "run", NOW, "m", configured_key=F.lit("k")).lines
    assert {r.cache_key for r in fixed.collect()} == {"k"}


def test_fetch_twice(spark, tmp_path):
    rows = [("b", 1, '{"custom_id":"a","output_text":"1"}'), ("b", 2, '{"custom_id":"a","output_text":"2"}'), ("b", 3, "bad"), ("open", 4, '{"custom_id":"z"}')]
    lines = spark.createDataFrame(rows, "batch_fk string, line_no int, line string")
    statuses = spark.createDataFrame([("b", "completed", '{"total":3}'), ("open", "in_progress", None), ("none", "completed", None)], "batch_fk string, status string, request_counts string")
    for run, (new, skipped) in enumerate([(2, 0), (0, 2)]):
        counts = {r.batch_fk: r for r in commands.fetch_results(spark, lines, statuses, f"{tmp_path}/store", f"{tmp_path}/summary{run}").collect()}
        assert (counts["b"].downloaded, counts["b"].skipped_existing) == (new, skipped) and counts["none"].downloaded == 0 and set(counts) == {"b", "none"}
        stored = spark.read.parquet(f"{tmp_path}/store").collect()
        assert [(r.custom_id, r.line_no) for r in stored] == [("a", 2)]
    assert spark.read.json(f"{tmp_path}/summary0").count() == 2


def test_extract(spark, tmp_path):
    rows = [("f", 1, '{"output_text":"Title\\nmore"}'), ("f", 2, "bad"), ("f", 3, '{"output_text":" two "}')]
    counts = commands.extract_documents(spark.createDataFrame(rows, "f string, n int, line string"), "f", "n", f"{tmp_path}/out").first()
    assert (counts.total, counts.ok, counts.bad) == (3, 2, 1)
    html = "".join(r.part for r in spark.read.parquet(f"{tmp_path}/out").orderBy("f", "part_no").collect())
    assert "<title>Title</title>" in html and "Title\nmore\n\n---\n\ntwo" in html and html.startswith("<!doctype html>") and html.endswith("</html>\n")


def test_annotate_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>TAX-01 é</p>")
    commands.annotate_files(spark, f"{tmp_path}/in", f"{tmp_path}/New")
    row = spark.read.parquet(f"{tmp_path}/New").first()
    assert row.name == "a.html" and 'data-kind="TAX"' in row.html and "é" in row.html


def echo(lines):
    """A provider: answers each request line with its own prompt."""
    text = F.get_json_object("line", "$.body.input[1].content[0].text")
    body = F.struct(F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(text.alias("text"))).alias("content"))).alias("output")).alias("body"))
    return lines.select(
        F.col("batch_no").cast("string").alias("batch_fk"), F.col("pos").alias("line_no"),
        F.to_json(F.struct(F.get_json_object("line", "$.custom_id").alias("custom_id"), body.alias("response"))).alias("line"))


def test_round_trip(spark):
    text = "".join(f"{corpus.DELIMITER}\nn = {i}\n{corpus.DELIMITER}\nbody {i}\n" for i in range(25))
    df = spark.createDataFrame([("p", "s", text)], "production_name string, source_name string, corpus string")
    new = production.new_productions(df, "t", "Write {{ meta.n }}: {{ text }}", NOW)
    requests = new.requests.withColumn("submit_claimed_until", F.lit(None).cast("timestamp_ntz"))
    lines = production.submission_lines(claims.claimable_requests(requests, NOW), ["created_at", "request_id"], "sys", "m")
    assert sorted(r["count"] for r in lines.groupBy("batch_no").count().collect()) == [5, 10, 10]
    links = lines.select(F.col("request_id").alias("request_fk"), F.col("batch_no").cast("string").alias("batch_fk"))
    good, bad = results.split_good_bad(jsonl.with_main_text(echo(lines)))
    answers = results.allowed_answers(good.withColumnRenamed("custom_id", "request_fk"), links)
    assert bad.count() == 0 and results.missing_answers(answers, links).count() == 0
    joined = answers.join(requests.withColumnRenamed("request_id", "request_fk"), "request_fk").collect()
    assert len(joined) == 25 and all(r.content == r.request_text.strip() for r in joined)
    log = new.request_events.select("request_id", "state", F.lit(1).alias("event_id"), F.lit("2026-01-01").alias("occurred_at")).unionByName(
        answers.select(F.col("request_fk").alias("request_id"), F.lit("completed").alias("state"), F.lit(2).alias("event_id"), F.lit("2026-01-03").alias("occurred_at")))
    assert {r.state for r in events.request_states(log).collect()} == {"completed"}
