"""Registered queries of the streaming jobs, run over everything their source holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.plans.documents import _ANSWER_CLASS, _DECODED
from promptmill.plans.inputs import AS_OF, Inputs
from promptmill.plans.lifecycle import _CLAIMABLE
from promptmill.plans.registry import query
from promptmill.session import shared_dir
from promptmill.streaming import jobs
from promptmill.streaming.runs import read_stream

LEASE_TIME = "2024-01-29 00:00:00"


def _dirs(t: Inputs, label: str) -> tuple[str, str]:
    base = shared_dir(t.spark, label)
    return f"{base}/out", f"{base}/checkpoint"


@query(f"""select request_id, cast((rn - 1) // 10 as bigint) as batch_no, cast((rn - 1) % 10 + 1 as bigint) as pos, request_text as user_text, 'submitted' as state from (
    select request_id, request_text, row_number() over (order by created_at, request_id) as rn from requests where {_CLAIMABLE}) x""", "requests")
def submit_stream(t: Inputs) -> DataFrame:
    out, checkpoint = _dirs(t, "submit")
    jobs.submit_stream(t.stream("requests", "orders"), out, checkpoint, AS_OF)
    lines, log = (jobs.submitted(t.spark, out, name) for name in ("request_lines", "request_events"))
    return lines.join(log.select("request_id", "state"), "request_id").select(
        "request_id", "batch_no", "pos", F.get_json_object("line", "$.body.input[1].content[0].text").alias("user_text"), "state")


@query("""with first as (select batch_fk, status, occurred_at as ended_at, event_id as eid from (select *, row_number() over (partition by batch_fk order by occurred_at, event_id) as rn
      from provider_reports where status in ('completed', 'failed', 'cancelled')) x where rn = 1),
    kept as (select r.* from provider_reports r left join first f on f.batch_fk = r.batch_fk where f.eid is null or r.occurred_at < ended_at or (r.occurred_at = ended_at and r.event_id <= eid))
    select case when status = 'expired' then 'poll_error' else 'polled' end as kind, cast(event_id as varchar) as key from kept
    union all select status, cast(eid as varchar) from first
    union all select 'outbox', batch_fk from first where status = 'completed'
    union all select 'cancelled_request', request_id || '/' || br.batch_fk from first f join batch_requests br on br.batch_fk = f.batch_fk
      join requests r on r.request_id = br.request_fk where f.status in ('failed', 'cancelled') and r.state = 'submitted'""",
       "provider_reports", "batch_requests", "requests")
def poll_stream(t: Inputs) -> DataFrame:
    out, checkpoint = _dirs(t, "poll")
    links, requests = t.batch_requests, t.requests
    jobs.poll_stream(t.stream("provider_reports", "events"), links, requests, out, checkpoint)
    read = lambda name: t.spark.read.parquet(f"{out}/{name}")
    reports = read("terminal").select("batch_fk", F.col("event_id").alias("report"))
    events = read("batch_events").join(reports, "batch_fk", "left")
    number = F.when(F.col("event_type").isin("polled", "poll_error"), F.col("event_id")).otherwise(F.col("report"))
    log = events.select(F.col("event_type").alias("kind"), number.cast("string").alias("key"))
    outbox = read("fetch_outbox").select(F.lit("outbox").alias("kind"), F.col("batch_fk").alias("key"))
    stopped = read("request_events").select(
        F.lit("cancelled_request").alias("kind"), F.concat("request_id", F.lit("/"), F.get_json_object("details", "$.batch_uid")).alias("key"))
    return log.unionByName(outbox).unionByName(stopped)


@query(f"""with {_DECODED}, a as (select batch_fk, doc_id as line_no, lower(custom_id) as request_fk, content, {_ANSWER_CLASS} as answer_class from decoded),
    ok as (select a.* from a join result_links l on l.request_fk = a.request_fk and l.batch_fk = a.batch_fk where answer_class = 'good'),
    counts as (select batch_fk, count(*) as total, count(*) filter (where request_fk in (select request_fk from ok)) as answered from result_links
      where batch_fk in (select batch_fk from a) group by batch_fk),
    handled as (select l.batch_fk, bool_and(l.request_fk in (select a.request_fk from a where a.batch_fk = l.batch_fk and a.request_fk is not null)) as whole
      from result_links l group by l.batch_fk)
    select 'answer' as kind, batch_fk, request_fk as key, content as value from ok
    union all select 'reject', batch_fk, cast(line_no as varchar), case when answer_class = 'good' then 'foreign_request' else answer_class end
      from a where line_no not in (select line_no from ok)
    union all select 'completed', batch_fk, request_fk, null from ok
    union all select 'counts', batch_fk, cast(answered as varchar), cast(total - answered as varchar) from counts
    union all select 'done', batch_fk, null, null from counts join handled using (batch_fk) where whole""",
       "result_files", "result_links")
def fetch_stream(t: Inputs) -> DataFrame:
    out, checkpoint = _dirs(t, "fetch")
    links = t.result_links
    jobs.fetch_stream(t.stream("result_stream", "documents", files_per_trigger=1), links, out, checkpoint)
    read = lambda name: t.spark.read.parquet(f"{out}/{name}")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, key, value=none) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "batch_fk", key.cast("string").alias("key"), value.cast("string").alias("value"))

    counts = jobs.current_batch_events(t.spark, out).where("event_type = 'answers_materialized'")
    number = lambda name: F.get_json_object("details", f"$.{name}")
    done = read("request_events").withColumn("batch_fk", F.get_json_object("details", "$.batch_uid"))
    return (
        rows(jobs.current_results(t.spark, out), "answer", F.col("request_fk"), F.col("content"))
        .unionByName(rows(jobs.current_rejects(t.spark, out), "reject", F.col("line_no"), F.col("reason")))
        .unionByName(rows(done, "completed", F.col("request_id")))
        .unionByName(rows(counts, "counts", number("ok_count"), number("missing_count")))
        .unionByName(rows(read("outbox_done").select("batch_fk").distinct(), "done", none)))


@query("select distinct batch_fk from provider_reports where status = 'completed'", "provider_reports")
def outbox_dedupe_stream(t: Inputs) -> DataFrame:
    out, checkpoint = _dirs(t, "outbox")
    jobs.outbox_dedupe_stream(t.stream("ready_batches", "events"), out, checkpoint)
    return jobs.outbox_table(t.spark, out).read().select("batch_fk")


@query("""with ranked as (select request_id, state, row_number() over (partition by request_id order by occurred_at desc, event_id desc) as newest,
      case when state in ('completed', 'cancelled') then row_number() over (partition by request_id, state in ('completed', 'cancelled') order by occurred_at, event_id) end as ended
      from request_events)
    select request_id, coalesce(max(state) filter (where ended = 1), max(state) filter (where newest = 1)) as state from ranked group by request_id""", "request_events")
def request_state_stream(t: Inputs) -> DataFrame:
    out, checkpoint = _dirs(t, "states")
    jobs.request_state_stream(t.stream("request_events", "events"), out, checkpoint)
    return jobs.current_states(t.spark, out)


@query(f"""with last as (select * from (select *, row_number() over (partition by request_id order by claimed_at desc, event_id desc) as rn from lease_grants) x where rn = 1)
    select l.request_id, l.claim_token, l.claimed_at + interval '60' second as claimed_until, l.claimed_at + interval '60' second < timestamp '{LEASE_TIME}' as is_free,
      count(u.event_id) filter (where u.claim_token = l.claim_token) as accepted, count(u.event_id) filter (where u.claim_token <> l.claim_token) as stale
    from last l left join late_updates u on u.request_id = l.request_id group by all""", "lease_grants", "late_updates")
def lease_expiry_stream(t: Inputs) -> DataFrame:
    out, checkpoint = _dirs(t, "leases")
    updates = t.late_updates
    jobs.lease_stream(t.stream("lease_grants", "events"), out, checkpoint)
    leases = jobs.current_leases(t.spark, out, LEASE_TIME)
    judged = jobs.judge_updates(updates, leases).groupBy("request_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("stale"))
    return leases.join(judged, "request_id", "left").select(
        "request_id", "claim_token", "claimed_until", "is_free", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("stale", F.lit(0)).alias("stale"))


LEASE_CUTS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")  # arrivals of the log, a micro-batch each


@query(f"""with seen as (select max(occurred_at) - interval '10' minute as now from lease_log),
    passed as (select l.* from lease_log l, seen where occurred_at < now),
    placed as (
      select *, last_value(case when kind = 'claim' then claim_token end ignore nulls) over (
        partition by request_id order by occurred_at, event_id rows between unbounded preceding and 1 preceding) as token from passed),
    claims as (
      select *, occurred_at + interval '60' second as until, lead(occurred_at) over (partition by request_id order by occurred_at, event_id) as next_at from passed where kind = 'claim')
    select request_id, 'claimed' as event_type, claim_token, event_id, occurred_at from claims
    union all select request_id, 'expired', claim_token, event_id, until from claims, seen where until < coalesce(next_at, now)
    union all select request_id, case when claim_token = token then 'accepted' else 'stale' end, claim_token, event_id, occurred_at from placed where kind = 'update'""",
       "lease_log")
def lease_event_stream(t: Inputs) -> DataFrame:
    out, checkpoint = _dirs(t, "lease-events")
    source = f"{out}/log"
    at = F.col("occurred_at")
    for low, high in zip(("1970-01-01",) + LEASE_CUTS, LEASE_CUTS + ("9999-01-01",), strict=True):
        t.lease_log.where((at >= F.lit(low).cast("timestamp")) & (at < F.lit(high).cast("timestamp"))).coalesce(1).write.mode("append").parquet(source)
    jobs.lease_event_stream(read_stream(t.spark, source, files_per_trigger=1), out, checkpoint)
    return t.spark.read.parquet(f"{out}/lease_events").select("request_id", "event_type", "claim_token", "event_id", at.cast("timestamp_ntz").alias("occurred_at"))
