"""Streaming jobs: several micro-batches equal one, restarts add nothing."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from promptmill.operators import claims, events
from promptmill.plans.inputs import AS_OF, Inputs
from promptmill.sources import jsonl
from promptmill.streaming import jobs, runs
from promptmill.streaming.runs import read_epochs, read_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The stream sources in four files each."""
    base = tmp_path_factory.mktemp("sources")
    t = Inputs(spark, SF)
    for name in ("requests", "request_events", "provider_reports", "result_stream", "lease_grants", "ready_batches"):
        getattr(t, name).repartition(4).write.parquet(f"{base}/{name}")
    return t, lambda name: read_stream(spark, f"{base}/{name}", files_per_trigger=1)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_submit(spark, tables, tmp_path):
    t, stream = tables
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    jobs.submit_stream(stream("requests"), out, cp, AS_OF)
    jobs.submit_stream(stream("requests"), out, cp, AS_OF)  # restart: nothing new
    links = spark.read.parquet(f"{out}/batch_requests")
    ready = claims.claimable_requests(t.requests, AS_OF)
    assert rows(links.select(F.col("request_fk").alias("request_id"))) == rows(ready.select("request_id"))
    sizes = links.groupBy("epoch", "batch_fk").count()
    assert sizes.where("count > 10").count() == 0 and sizes.where("count < 10").groupBy("epoch").count().where("count > 1").count() == 0
    assert spark.read.parquet(f"{out}/batches").count() == links.select("batch_fk").distinct().count() == spark.read.parquet(f"{out}/batch_events").count()
    assert spark.read.parquet(f"{out}/request_lines").select("epoch").distinct().count() > 1


def test_poll_in_order_of_arrival(spark, tables, tmp_path):
    t, stream = tables
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    for _ in range(2):
        jobs.poll_stream(stream("provider_reports"), t.batch_requests, t.requests, out, cp)
    log = spark.read.parquet(f"{out}/batch_events")
    terminal = log.where(claims.is_terminal_event())
    reported = t.provider_reports.where(F.col("status").isin("completed", "failed", "cancelled")).select("batch_fk").distinct()
    assert rows(terminal.select("batch_fk")) == rows(reported)  # exactly one end per batch
    assert rows(spark.read.parquet(f"{out}/fetch_outbox").select("batch_fk")) == rows(terminal.where("event_type = 'completed'").select("batch_fk"))
    late = log.alias("a").join(terminal.alias("b"), "batch_fk").where("a.epoch > b.epoch")
    assert late.count() == 0  # nothing is recorded for a batch once it has ended
    cancelled = spark.read.parquet(f"{out}/request_events")
    submitted = t.requests.where("state = 'submitted'")
    assert cancelled.join(submitted, "request_id", "left_anti").count() == 0


def test_fetch(spark, tables, tmp_path):
    t, stream = tables
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    jobs.fetch_stream(stream("result_stream"), t.result_links, f"{many}/out", f"{many}/cp")
    jobs.fetch_stream(t.stream("result_stream", "documents"), t.result_links, f"{one}/out", f"{one}/cp")
    assert rows(jobs.current_results(spark, f"{many}/out")) == rows(jobs.current_results(spark, f"{one}/out"))
    for name in ("rejects", "request_events"):
        a, b = (spark.read.parquet(f"{d}/out/{name}").drop("epoch") for d in (one, many))
        assert rows(a) == rows(b)
    a, b = (jobs.current_batch_events(spark, f"{d}/out") for d in (one, many))
    assert rows(a) == rows(b) and a.count() == a.select("event_id").distinct().count()
    a, b = (spark.read.parquet(f"{d}/out/outbox_done").select("batch_fk").distinct() for d in (one, many))
    assert rows(a) == rows(b)
    lines = t.result_stream.count()
    answers, rejects = (spark.read.parquet(f"{many}/out/{n}").count() for n in ("answers", "rejects"))
    assert answers + rejects == lines  # every line is accounted for


def test_states_and_leases(spark, tables, tmp_path):
    t, stream = tables
    jobs.request_state_stream(stream("request_events"), f"{tmp_path}/s", f"{tmp_path}/scp")
    assert rows(jobs.current_states(spark, f"{tmp_path}/s")) == rows(events.request_states(t.request_events))
    jobs.lease_stream(stream("lease_grants"), f"{tmp_path}/l", f"{tmp_path}/lcp")
    leases = jobs.current_leases(spark, f"{tmp_path}/l", "2024-01-15 00:00:00")
    want = t.lease_grants.groupBy("request_id").agg(F.max_by("claim_token", F.struct("claimed_at", "event_id")).alias("claim_token"))
    assert rows(leases.select("request_id", "claim_token")) == rows(want)
    held = leases.where(~F.col("is_free"))
    assert held.where("claimed_until < timestamp_ntz '2024-01-15 00:00:00'").count() == 0
    assert jobs.judge_updates(want, leases).where("not accepted").count() == 0


def test_outbox_once(spark, tables, tmp_path):
    t, stream = tables
    for _ in range(2):
        jobs.outbox_dedupe_stream(stream("ready_batches").union(stream("ready_batches")), f"{tmp_path}/o", f"{tmp_path}/cp")
    assert rows(jobs.outbox_table(spark, f"{tmp_path}/o").read().select("batch_fk")) == rows(t.ready_batches.select("batch_fk").distinct())


def test_missing_table_reads_empty(spark, tmp_path):
    schema = spark.createDataFrame([], "a int").schema
    assert read_epochs(spark, f"{tmp_path}/none", schema).count() == 0


def test_fetch_from_files(spark, tmp_path):
    uid = "00000000-0000-4000-8000-00000000000"
    links = spark.createDataFrame([(uid + "1", "b1"), (uid + "2", "b1"), (uid + "3", "b2")], "request_fk string, batch_fk string")
    folder, out, cp = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp"
    folder.mkdir()
    answer = lambda i, t: '{"custom_id":"%s%d","output_text":"%s"}' % (uid, i, t)
    (folder / "b1.jsonl").write_text(answer(1, "old") + "\n\n" + answer(1, "new") + "\nbad\n")
    jobs.fetch_stream(jsonl.stream_result_files(spark, str(folder)), links, out, cp)
    (folder / "b2.jsonl").write_text(answer(3, "three") + "\n" + answer(2, "foreign") + "\n")
    jobs.fetch_stream(jsonl.stream_result_files(spark, str(folder)), links, out, cp)
    got = {(r.batch_fk, r.request_fk[-1]): r.content for r in jobs.current_results(spark, out).collect()}
    assert got == {("b1", "1"): "new", ("b2", "3"): "three"}
    log = {(r.batch_fk, r.event_type): json.loads(r.details) for r in spark.read.parquet(f"{out}/batch_events").collect()}
    assert log["b1", "answers_materialized"] == {"event": "answers_materialized", "ok_count": 1, "missing_count": 1, "batch_request_count": 2}
    raw = {r.batch_fk: (r.locator, r.bytes) for r in spark.read.parquet(f"{out}/s3_objects").collect()}
    assert raw["b2"][1] == len((folder / "b2.jsonl").read_bytes()) and log["b2", "raw_fetched"]["raw_result_locator"] == raw["b2"][0]
    assert {(r.batch_fk, r.reason) for r in spark.read.parquet(f"{out}/rejects").collect()} == {("b1", "invalid_json"), ("b2", "foreign_request")}
    assert jsonl.read_result_files(spark, str(folder)).count() == 5


def test_run_time_skew_handling_in_micro_batches(spark, tables, tmp_path):
    """Joins in micro-batches do not rely on adaptive execution; both settings give the same rows."""
    t, stream = tables
    seen = []
    for flag in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", flag)
        jobs.poll_stream(stream("provider_reports"), t.batch_requests, t.requests, f"{tmp_path}/{flag}", f"{tmp_path}/cp{flag}")
        seen.append(rows(spark.read.parquet(f"{tmp_path}/{flag}/fetch_outbox").select("batch_fk")))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(seen[0]) > 0 and seen[0] == seen[1]


def test_standing_query(spark, tables, tmp_path):
    t, stream = tables
    query = jobs.request_state_stream(stream("request_events"), f"{tmp_path}/s", f"{tmp_path}/cp", every="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert rows(jobs.current_states(spark, f"{tmp_path}/s")) == rows(events.request_states(t.request_events))


def feed(spark, tmp_path, name, *parts):
    """A stream over a folder that gets one more file per call."""
    folder = f"{tmp_path}/{name}"
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)
    return read_stream(spark, folder, files_per_trigger=1)


def test_leased_requests_wait_and_are_submitted_once(spark, tmp_path):
    schema = "request_id string, request_text string, state string, submit_claimed_until timestamp_ntz, created_at timestamp_ntz"
    made = spark.sql("select inline(array(struct('r1', 'a', 'entered', cast(null as timestamp_ntz), timestamp_ntz '2026-01-01'), "
                     "struct('r2', 'b', 'entered', timestamp_ntz '2026-01-03', timestamp_ntz '2026-01-01')))").toDF(*[c.split()[0] for c in schema.split(", ")])
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    stream = feed(spark, tmp_path, "in", made)
    sent = lambda: sorted(r.request_fk for r in spark.read.parquet(f"{out}/batch_requests").collect())
    jobs.submit_stream(stream, out, cp, "2026-01-02 00:00:00")
    assert sent() == ["r1"]
    jobs.submit_stream(stream, out, cp, lambda: "2026-01-05 00:00:00")  # nothing new arrives; the lease has run out
    assert sent() == ["r1", "r2"]
    jobs.submit_stream(feed(spark, tmp_path, "in", made), out, cp, "2026-01-06 00:00:00")  # delivered again
    assert sent() == ["r1", "r2"]
    log = spark.read.parquet(f"{out}/request_events")
    assert log.count() == 2 and log.where("event_id is null or occurred_at is null").count() == 0


REQUESTS = "request_id string, request_text string, state string, submit_claimed_until timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"


def requests_at(spark, *rows):
    """(request_id, state, end of its lease or None, day of its last change)"""
    made = [(i, f"text {i}", state, lease, "2026-01-01", day) for i, state, lease, day in rows]
    raw = spark.createDataFrame(made, "request_id string, request_text string, state string, submit_claimed_until string, created_at string, updated_at string")
    return raw.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in REQUESTS.split(", ")])


class Killed(Exception):
    pass


def killing(monkeypatch, at):
    """Let the ``at``-th write of a table fail once it is done (never for None); counts the writes."""
    whole, seen = runs.write_epoch, []

    def write(*args):
        out = whole(*args)
        seen.append(args[1])
        if len(seen) - 1 == at:
            raise Killed(args[1])
        return out

    monkeypatch.setattr(runs, "write_epoch", write)
    monkeypatch.setattr(jobs, "write_epoch", write)
    return seen


def submit_twice(spark, out, fresh, monkeypatch, kill):
    """A micro-batch in which one batch is refused, then a retry; whatever is killed is started again."""
    clock, calls = ["2026-01-02 00:00:00"], []

    def send(lines):
        calls.append({(r.batch_uid, r.pos, r.request_id, r.line) for r in lines.collect()})
        refused = (F.count(F.lit(1)) < 10) & F.lit(clock[0] < "2026-01-03")
        return lines.groupBy("batch_uid").agg(F.when(refused, "E1").alias("error_code"), F.when(refused, "busy").alias("error_message")).withColumn(
            "provider_batch_id", F.concat(F.lit("p"), "batch_uid"))

    log = jobs.SubmitLog(out, fresh.schema, lambda: clock[0], send, system_text="", model="m")
    writes = killing(monkeypatch, kill)
    for time, df, number in (("2026-01-02 00:00:00", fresh, 0), ("2026-01-05 00:00:00", None, None)):
        clock[0] = time
        try:
            log.step(df, spark, "q", number)
        except Killed:
            if df is not None or not log.waiting(spark).isEmpty():
                log.step(df, spark, "q", number)
    sent = {}
    for call in calls:
        for uid in {c[0] for c in call}:
            assert sent.setdefault(uid, lines := {c for c in call if c[0] == uid}) == lines  # the same batch id never stands for other lines
    tables = {name: rows(jobs.submitted(spark, out, name)) for name in ("request_lines", "batches", "batch_events", "batch_requests", "request_events", "pending")}
    monkeypatch.undo()
    return tables, writes


def test_a_crash_after_any_write_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    quick = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in quick}
    for k, v in quick.items():  # tiny jobs, many of them
        spark.conf.set(k, v)
    fresh = requests_at(spark, *[(f"r{i:02d}", "entered", "2026-01-04" if i == 12 else None, "2026-01-01") for i in range(13)]).cache()
    want, writes = submit_twice(spark, f"{tmp_path}/whole", fresh, monkeypatch, None)
    linked = spark.read.parquet(f"{tmp_path}/whole/batch_requests")
    assert sorted(r.request_fk for r in linked.collect()) == [f"r{i:02d}" for i in range(13)]
    failed = [json.loads(r.details) for r in jobs.submitted(spark, f"{tmp_path}/whole", "request_events").where("state = 'entered'").collect()]
    assert failed == [{"event": "submit_failed", "error_code": "E1", "error_message": "busy"}] * 2  # both went back and were sent with the retry
    for kill in range(len(writes)):
        got, _ = submit_twice(spark, f"{tmp_path}/{kill}", fresh, monkeypatch, kill)
        assert got == want, writes[kill]
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_stream_killed_in_its_retry_goes_on(spark, tmp_path, monkeypatch):
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    stream = feed(spark, tmp_path, "in", requests_at(spark, ("r1", "entered", None, "2026-01-01"), ("r2", "entered", "2026-01-03", "2026-01-01")))
    jobs.submit_stream(stream, out, cp, "2026-01-02 00:00:00")
    for kill in (0, 6):
        killing(monkeypatch, kill)
        with pytest.raises(Killed):
            jobs.submit_stream(stream, out, cp, "2026-01-05 00:00:00")
        monkeypatch.undo()
    for _ in range(2):
        jobs.submit_stream(stream, out, cp, "2026-01-05 00:00:00")
    assert sorted(r.request_fk for r in jobs.submitted(spark, out, "batch_requests").collect()) == ["r1", "r2"]


def test_cancelled_requests_are_not_submitted(spark, tmp_path):
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    first = requests_at(spark, ("r1", "entered", "2026-01-04", "2026-01-01"), ("r3", "entered", "2026-01-04", "2026-01-01"))
    cancelled = requests_at(spark, ("r1", "cancelled", None, "2026-01-02"), ("r2", "cancelled", None, "2026-01-02"))
    late = requests_at(spark, ("r2", "entered", None, "2026-01-01"))  # overtaken by its own cancellation
    for part in (first, cancelled, late):
        jobs.submit_stream(feed(spark, tmp_path, "in", part), out, cp, "2026-01-03 00:00:00")
    jobs.submit_stream(feed(spark, tmp_path, "in"), out, cp, "2026-01-05 00:00:00")
    assert [r.request_fk for r in jobs.submitted(spark, out, "batch_requests").collect()] == ["r3"]


def test_a_new_checkpoint_is_another_stream(spark, tmp_path):
    out = f"{tmp_path}/out"
    for name in ("r1", "r2"):  # both are micro-batch 0 of their streams
        part = requests_at(spark, (name, "entered", None, "2026-01-01"))
        jobs.submit_stream(feed(spark, tmp_path, name, part), out, f"{tmp_path}/cp-{name}", "2026-01-03 00:00:00")
    assert sorted(r.request_fk for r in jobs.submitted(spark, out, "batch_requests").collect()) == ["r1", "r2"]


UID = "00000000-0000-4000-8000-00000000000"


def answer(spark, batch, *lines):
    made = [(batch, n, '{"custom_id":"%s%s","output_text":"%s"}' % (UID, i, t) if i else None, t if not i else None) for n, i, t in lines]
    return spark.createDataFrame(made, "batch_fk string, line_no bigint, line string, error string")


def test_fetch_counts_a_batch_over_micro_batches(spark, tmp_path):
    links = spark.createDataFrame([(UID + "1", "b1"), (UID + "2", "b1")], "request_fk string, batch_fk string")
    requests = spark.createDataFrame([(UID + "1", "submitted"), (UID + "2", "submitted")], "request_id string, state string")
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    stream = feed(spark, tmp_path, "in", answer(spark, "b1", (1, "1", "x")), answer(spark, "b1", (2, "2", "y")), answer(spark, "b1", (1, "1", "x")))
    run = lambda: jobs.fetch_stream(stream, lambda _: links, out, cp, requests=lambda _: requests, outbox=lambda _: links, as_of="2026-01-01 00:00:00")
    run()
    run()
    events_now = {r.event_type: json.loads(r.details) for r in jobs.current_batch_events(spark, out).collect()}
    assert events_now["answers_materialized"] == {"event": "answers_materialized", "ok_count": 2, "missing_count": 0, "batch_request_count": 2}
    done = spark.read.parquet(f"{out}/request_events")
    assert sorted(r.request_id for r in done.collect()) == [UID + "1", UID + "2"] and done.where("event_id is null or occurred_at is null").count() == 0
    left = {r.epoch for r in spark.read.parquet(f"{out}/outbox_done").collect()}
    assert 0 not in left and left  # not before the second line was there


def test_fetch_sees_links_that_come_later_and_reports_failures(spark, tmp_path):
    path, out, cp = f"{tmp_path}/links", f"{tmp_path}/out", f"{tmp_path}/cp"
    spark.createDataFrame([(UID + "1", "b1")], "request_fk string, batch_fk string").write.parquet(path)
    query = jobs.fetch_stream(feed(spark, tmp_path, "in", answer(spark, "b1", (1, "1", "x"))), path, out, cp, every="1 second", as_of="2026-01-01 00:00:00")
    try:
        query.processAllAvailable()
        spark.createDataFrame([(UID + "2", "b2")], "request_fk string, batch_fk string").write.mode("append").parquet(path)
        feed(spark, tmp_path, "in", answer(spark, "b2", (1, "2", "y")), answer(spark, "b3", (1, None, "gone")))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted((r.batch_fk, r.content) for r in jobs.current_results(spark, out).collect()) == [("b1", "x"), ("b2", "y")]
    assert jobs.current_rejects(spark, out).count() == 0
    lost = [r for r in jobs.current_batch_events(spark, out).collect() if r.event_type == "fetch_failed"]
    assert [r.batch_fk for r in lost] == ["b3"] and json.loads(lost[0].details)["error_message"] == "gone"
    assert [(r.batch_fk, str(r.fetch_claimed_until)) for r in spark.read.parquet(f"{out}/fetch_leases").collect()] == [("b3", "2026-01-01 00:05:00")]


def test_outbox_takes_late_rows_and_repeats_none(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame(list(rows), "batch_fk string, at string").select("batch_fk", F.col("at").cast("timestamp").alias("occurred_at"))
    stream = feed(spark, tmp_path, "in", made(("x", "2026-01-01")), made(("y", "2027-01-01")), made(("late", "2020-01-01"), ("x", "2027-06-01")))
    for _ in range(2):
        jobs.outbox_dedupe_stream(stream, f"{tmp_path}/o", f"{tmp_path}/cp")
    assert sorted(r.batch_fk for r in jobs.outbox_table(spark, f"{tmp_path}/o").read().collect()) == ["late", "x", "y"]


def test_poll_needs_the_token_of_the_lease(spark, tmp_path):
    batches = spark.createDataFrame([("b1", "t1"), ("b2", "t2")], "uid string, poll_claim_token string")
    links = spark.createDataFrame([("r1", "b1"), ("r2", "b2")], "request_fk string, batch_fk string")
    requests = spark.createDataFrame([("r1", "submitted"), ("r2", "submitted")], "request_id string, state string")
    reports = [(1, "b1", "in_progress", None, "2026-01-01", "t1"), (2, "b2", "failed", None, "2026-01-01", "old"), (3, "b1", "cancelled", None, "2026-01-02", "t1")]
    made = spark.createDataFrame(reports, "event_id bigint, batch_fk string, status string, error_file_id string, at string, poll_claim_token string").withColumn("occurred_at", F.col("at").cast("timestamp_ntz")).drop("at")
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    stream = feed(spark, tmp_path, "in", made.where("event_id < 3"), made.where("event_id = 3"))
    jobs.poll_stream(stream, lambda _: links, lambda _: requests, out, cp, batches=lambda _: batches)
    assert [r.event_id for r in spark.read.parquet(f"{out}/stale_reports").collect()] == [2]
    assert [r.request_id for r in spark.read.parquet(f"{out}/request_events").collect()] == ["r1"]
    held = {r.epoch: r.poll_claimed_until for r in spark.read.parquet(f"{out}/poll_leases").collect()}
    assert held[0] is not None and held[1] is None


def test_a_batch_with_a_bad_line_leaves_the_outbox(spark, tmp_path):
    links = spark.createDataFrame([(UID + "1", "b1"), (UID + "2", "b1"), (UID + "3", "b2")], "request_fk string, batch_fk string")
    lines = answer(spark, "b1", (1, "1", "x"), (2, "2", "   ")).unionByName(answer(spark, "b2", (1, "9", "of nobody")))
    out = f"{tmp_path}/out"
    jobs.fetch_stream(feed(spark, tmp_path, "in", lines), lambda _: links, out, f"{tmp_path}/cp", outbox=lambda _: links, as_of="2026-01-01 00:00:00")
    assert [r.batch_fk for r in spark.read.parquet(f"{out}/outbox_done").collect()] == ["b1"]  # answered and refused by id; b2's request is open
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "b1.jsonl").write_text("bad\n" * 3)
    jobs.fetch_stream(jsonl.stream_result_files(spark, str(folder)), lambda _: links, f"{out}2", f"{tmp_path}/cp2", outbox=lambda _: links)
    assert [r.batch_fk for r in spark.read.parquet(f"{out}2/outbox_done").collect()] == ["b1"]  # a file comes whole


def lease_rule(rows, now, ttl):
    """Events of lease rows (request, kind, token, event, second) that the time ``now`` has passed."""
    out, held = [], {}

    def run_out(key, before):
        if key in held and held[key][3] and held[key][2] < before:
            held[key][3] = False
            out.append((key, "expired", held[key][0], held[key][1], held[key][2]))

    for key, kind, token, event, at in sorted(rows, key=lambda r: (r[4], r[3])):
        if at >= now:
            continue
        run_out(key, at)
        if kind == "claim":
            held[key] = [token, event, at + ttl, True]
            out.append((key, "claimed", token, event, at))
        else:
            out.append((key, "accepted" if key in held and held[key][0] == token else "stale", token, event, at))
    for key in held:
        run_out(key, now)
    return sorted(out)


def test_lease_timers_over_micro_batches(spark, tmp_path):
    rng = random.Random(11)
    rows = [(f"r{rng.randrange(6)}", rng.choice(["claim", "update"]), f"t{rng.randrange(2)}", i, rng.randrange(3000)) for i in range(150)]
    rows.append(("end", "claim", "t", 999, 10_000))
    late = sorted(rows, key=lambda r: r[4] + rng.randrange(500))  # out of order, within the delay
    made = lambda part: spark.createDataFrame(part, "request_id string, kind string, claim_token string, event_id bigint, s bigint").select(
        "request_id", "kind", "claim_token", "event_id", F.timestamp_seconds("s").alias("occurred_at"))
    parts = [made(late[i: i + 40]) for i in range(0, len(late), 40)]
    jobs.lease_event_stream(feed(spark, tmp_path, "in", *parts[:2]), f"{tmp_path}/out", f"{tmp_path}/cp", ttl=60, delay="600 seconds")
    for _ in range(2):  # goes on from its state
        jobs.lease_event_stream(feed(spark, tmp_path, "in", *parts[2:]), f"{tmp_path}/out", f"{tmp_path}/cp", ttl=60, delay="600 seconds")
        parts = []
    got = [(r.request_id, r.event_type, r.claim_token, r.event_id, r.s) for r in spark.read.parquet(f"{tmp_path}/out/lease_events").withColumn("s", F.unix_seconds("occurred_at")).collect()]
    assert sorted(got) == lease_rule(rows, 10_000 - 600, 60)
    assert {r[1] for r in got} == {"claimed", "expired", "accepted", "stale"}


def test_fetch_writes_independent_tables_side_by_side(spark, tmp_path, monkeypatch):
    at_once, most, held = set(), [0], threading.Lock()

    def write(df, path, epoch):
        with held:
            at_once.add(path)
            most[0] = max(most[0], len(at_once))
        try:
            return runs.write_epoch(df, path, epoch)
        finally:
            with held:
                at_once.discard(path)

    monkeypatch.setattr(jobs, "write_epoch", write)
    links = spark.createDataFrame([("b1", UID + "1")], "batch_fk string, request_fk string")
    out = f"{tmp_path}/out"
    jobs.fetch_stream(feed(spark, tmp_path, "in", answer(spark, "b1", (1, "1", "x"))), links, out, f"{tmp_path}/cp", as_of="2026-01-01 00:00:00")
    assert most[0] > 1 and jobs.current_results(spark, out).count() == 1 and spark.read.parquet(f"{out}/outbox_done").count() == 1

    def fails():
        raise ValueError("no")

    spark.sparkContext.setLocalProperty("k", "v")
    assert runs.together(spark, lambda: spark.sparkContext.getLocalProperty("k"), lambda: 2) == ["v", 2]
    with pytest.raises(ValueError):
        runs.together(spark, fails, lambda: 2)
