"""Registered queries: leases, transitions, batches, results tables, audits, responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill import schemas
from promptmill.functions import details, variants
from promptmill.functions.text import as_time
from promptmill.operators import audit, claims, events, numbering, responses, results, upserts
from promptmill.plans.inputs import AS_OF, Inputs
from promptmill.plans.registry import query

_NOW = f"timestamp '{AS_OF}'"
_CLAIMABLE = f"state = 'entered' and (submit_claimed_until is null or submit_claimed_until < {_NOW})"
_POLL_FREE = f"(poll_claimed_until is null or poll_claimed_until < {_NOW})"
_FETCH_FREE = f"(fetch_claimed_until is null or fetch_claimed_until < {_NOW})"
_OPEN = """exists (select 1 from batch_requests br join requests r on r.request_id = br.request_fk
    where br.batch_fk = b.uid and r.state = 'submitted')"""
_TERMINAL = "exists (select 1 from batch_events e where e.batch_fk = b.uid and e.event_type in ('completed', 'cancelled', 'failed'))"


# ---- claims ---------------------------------------------------------------------------

@query(f"select request_id, request_text from requests where {_CLAIMABLE}", "requests")
def claimable_requests(t: Inputs) -> DataFrame:
    return claims.claimable_requests(t.requests, AS_OF).select("request_id", "request_text")


@query(f"select request_id, created_at from requests where {_CLAIMABLE} order by created_at, request_id limit 10", "requests")
def oldest_claimable(t: Inputs) -> DataFrame:
    return claims.oldest(claims.claimable_requests(t.requests, AS_OF), 10, "request_id").select("request_id", "created_at")


@query(f"""select request_id, cast((rn - 1) // 10 as bigint) as batch_no, cast((rn - 1) % 10 + 1 as bigint) as pos from (
    select request_id, row_number() over (order by created_at, request_id) as rn from requests where {_CLAIMABLE}) x""", "requests")
def assign_batches(t: Inputs) -> DataFrame:
    ready = claims.claimable_requests(t.requests, AS_OF).select("request_id", "created_at")
    return numbering.fixed_groups(ready, schemas.BATCH_SIZE, ["created_at", "request_id"]).select("request_id", "batch_no", "pos")


@query(f"""with picked as (select request_id as pid from requests where {_CLAIMABLE} order by created_at, request_id limit 10)
    select request_id, case when pid is null then submit_claimed_by else 'worker' end as submit_claimed_by,
      case when pid is null then submit_claim_token else 'token-1' end as submit_claim_token,
      case when pid is null then submit_claimed_until else {_NOW} + interval '60' second end as submit_claimed_until,
      case when pid is null then updated_at else {_NOW} end as updated_at
    from requests left join picked on pid = request_id""", "requests")
def claim_update(t: Inputs) -> DataFrame:
    requests = t.requests
    picked = claims.oldest(claims.claimable_requests(requests, AS_OF), 10, "request_id")
    return claims.claim(requests, picked, "request_id", "submit", "worker", "token-1", AS_OF).select(
        "request_id", "submit_claimed_by", "submit_claim_token", "submit_claimed_until", "updated_at")


@query(f"""select r.request_id, case when hit then 'submitted' else r.state end as state,
      case when hit then null else r.submit_claim_token end as submit_claim_token,
      case when hit then null else r.submit_claimed_until end as submit_claimed_until,
      case when hit then {_NOW} else r.updated_at end as updated_at
    from (select r.*, coalesce(r.state = 'entered' and r.submit_claim_token = k.submit_claim_token, false) as hit
      from requests r left join request_tokens k on k.request_id = r.request_id) r""", "requests", "request_tokens")
def guarded_transition(t: Inputs) -> DataFrame:
    return claims.transition(t.requests, t.request_tokens, "submitted", AS_OF, from_state="entered").select(
        "request_id", "state", "submit_claim_token", "submit_claimed_until", "updated_at")


@query(f"""select o.batch_fk, case when k.batch_fk is null then o.fetch_claim_token end as fetch_claim_token,
      case when k.batch_fk is null then o.fetch_claimed_until else {_NOW} + interval '300' second end as fetch_claimed_until
    from fetch_outbox o left join outbox_tokens k on k.batch_fk = o.batch_fk and k.fetch_claim_token = o.fetch_claim_token""",
       "fetch_outbox", "outbox_tokens")
def release_with_backoff(t: Inputs) -> DataFrame:
    return claims.release_with_backoff(t.fetch_outbox, t.outbox_tokens, "batch_fk", "fetch", AS_OF).select(
        "batch_fk", "fetch_claim_token", "fetch_claimed_until")


@query(f"""select o.batch_fk, case when hit then 'worker' else o.fetch_claimed_by end as fetch_claimed_by,
      case when hit then 'token-2' else o.fetch_claim_token end as fetch_claim_token,
      case when hit then {_NOW} + interval '60' second else o.fetch_claimed_until end as fetch_claimed_until
    from (select o.*, b.uid is not null and {_FETCH_FREE} as hit from fetch_outbox o left join batches b on b.uid = o.batch_fk) o""",
       "fetch_outbox", "batches")
def claim_one(t: Inputs) -> DataFrame:
    wanted = t.batches.select(F.col("uid").alias("batch_fk"))
    return claims.claim_one(t.fetch_outbox, wanted, "batch_fk", "fetch", "worker", "token-2", AS_OF).select(
        "batch_fk", "fetch_claimed_by", "fetch_claim_token", "fetch_claimed_until")


@query("""select batch_fk, created_at from fetch_outbox o where not exists (select 1 from outbox_tokens k
    where k.batch_fk = o.batch_fk and k.fetch_claim_token = o.fetch_claim_token)""", "fetch_outbox", "outbox_tokens")
def guarded_delete(t: Inputs) -> DataFrame:
    return claims.delete_claimed(t.fetch_outbox, t.outbox_tokens, "batch_fk", "fetch").select("batch_fk", "created_at")


# ---- batches --------------------------------------------------------------------------

@query(f"select o.batch_fk, b.provider_batch_id from fetch_outbox o join batches b on b.uid = o.batch_fk where {_FETCH_FREE}",
       "fetch_outbox", "batches")
def outbox_with_batches(t: Inputs) -> DataFrame:
    return claims.outbox_with_batches(t.fetch_outbox, t.batches, AS_OF).select("batch_fk", "provider_batch_id")


@query(f"select uid, provider_batch_id from batches b where {_OPEN}", "batches", "batch_requests", "requests")
def batches_with_open_requests(t: Inputs) -> DataFrame:
    return claims.batches_with_open_requests(t.batches, t.batch_requests, t.requests).select("uid", "provider_batch_id")


@query(f"select uid, provider_batch_id from batches b where not {_TERMINAL}", "batches", "batch_events")
def batches_without_terminal(t: Inputs) -> DataFrame:
    return claims.batches_without_terminal(t.batches, t.batch_events).select("uid", "provider_batch_id")


@query(f"""select uid, provider_batch_id, created_at from batches b where {_POLL_FREE} and {_OPEN} and not {_TERMINAL}
    order by created_at, uid limit 10""", "batches", "batch_requests", "requests", "batch_events")
def pollable_batches(t: Inputs) -> DataFrame:
    return claims.pollable_batches(t.batches, t.batch_requests, t.requests, t.batch_events, AS_OF).select("uid", "provider_batch_id", "created_at")


@query(f"""with gone as (select distinct br.request_fk as rid from batch_requests br join batches b on b.uid = br.batch_fk
      join poll_tokens k on k.uid = b.uid and k.poll_claim_token = b.poll_claim_token)
    select request_id, case when rid is not null and state = 'submitted' then 'cancelled' else state end as state,
      case when rid is not null and state = 'submitted' then {_NOW} else updated_at end as updated_at
    from requests left join gone on rid = request_id""", "requests", "batch_requests", "batches", "poll_tokens")
def cancel_batch_requests(t: Inputs) -> DataFrame:
    return claims.cancel_batch_requests(t.requests, t.batch_requests, t.batches, t.poll_tokens, AS_OF).select("request_id", "state", "updated_at")


@query(f"""select batch_fk, request_id, updated_at from (select br.batch_fk, r.request_id, r.updated_at,
      row_number() over (partition by br.batch_fk order by r.updated_at, r.request_id) as rn
      from batch_requests br join requests r on r.request_id = br.request_fk
      where r.state = 'submitted' and (submit_claimed_until is null or submit_claimed_until < {_NOW})) x where rn = 1""",
       "requests", "batch_requests")
def oldest_request_per_batch(t: Inputs) -> DataFrame:
    return claims.oldest_request_per_batch(t.requests, t.batch_requests, AS_OF)


@query(f"select batch_fk, request_fk from batch_requests br where exists (select 1 from batches b where b.uid = br.batch_fk and {_TERMINAL})",
       "batch_requests", "batches", "batch_events")
def batch_members(t: Inputs) -> DataFrame:
    ended = claims.terminal_batch_keys(t.batch_events).select(F.col("uid").alias("batch_fk"))
    return claims.batch_members(t.batch_requests, ended)


@query("select batch_fk, count(*) as request_count from batch_requests group by batch_fk", "batch_requests")
def batch_request_count(t: Inputs) -> DataFrame:
    return results.batch_request_count(t.batch_requests)


# ---- answers of batches ---------------------------------------------------------------

@query("""with a as (select distinct batch_fk, request_fk from answers)
    select coalesce(a.batch_fk, r.batch_fk) as batch_fk, count(*) filter (where a.request_fk is not null and r.request_fk is not null) as ok_count,
      count(*) filter (where a.request_fk is null) as missing_count, count(r.request_fk) as batch_request_count,
      count(*) filter (where r.request_fk is null) as foreign_count
    from a full join batch_requests r on r.batch_fk = a.batch_fk and r.request_fk = a.request_fk group by 1""", "answers", "batch_requests")
def answers_materialized(t: Inputs) -> DataFrame:
    return results.answers_materialized(t.answers, t.batch_requests)


@query("""select batch_fk, request_fk from batch_requests r where not exists (select 1 from answers a
    where a.batch_fk = r.batch_fk and a.request_fk = r.request_fk)""", "answers", "batch_requests")
def missing_answers(t: Inputs) -> DataFrame:
    return results.missing_answers(t.answers, t.batch_requests).select("batch_fk", "request_fk")


@query("""select batch_fk, request_fk, line_no, part_no from answers a where exists (select 1 from batch_requests r
    where a.batch_fk = r.batch_fk and a.request_fk = r.request_fk)""", "answers", "batch_requests")
def allowed_answers(t: Inputs) -> DataFrame:
    return results.allowed_answers(t.answers, t.batch_requests).select("batch_fk", "request_fk", "line_no", "part_no")


@query(f"""with last as (select * from (select *, row_number() over (partition by batch_fk, request_fk order by line_no desc, part_no desc) as rn
      from answers) x where rn = 1)
    select coalesce(e.batch_fk, l.batch_fk) as batch_fk, coalesce(e.request_fk, l.request_fk) as request_fk,
      coalesce(e.created_at, {_NOW}) as created_at, case when l.rn = 1 then coalesce(l.metadata, 'null') else e.metadata end as metadata,
      case when l.rn = 1 then coalesce(l.content, '') else e.content end as content
    from request_results e full join last l on l.batch_fk = e.batch_fk and l.request_fk = e.request_fk""", "request_results", "answers")
def upsert_results(t: Inputs) -> DataFrame:
    out = results.upsert_results(t.request_results, t.answers, ["line_no", "part_no"], as_time(AS_OF))
    return out.select("batch_fk", "request_fk", "created_at", "metadata", "content")


@query("""with fresh as (select distinct batch_fk from batch_events where event_type = 'completed')
    select batch_fk, metadata from fetch_outbox union all
    select batch_fk, '{"new":true}' as metadata from (select uid as batch_fk from batches union select batch_fk from fresh) f
    where batch_fk not in (select batch_fk from fetch_outbox)""", "batch_events", "fetch_outbox", "batches")
def insert_if_absent(t: Inputs) -> DataFrame:
    done = t.batch_events.where(F.col("event_type") == "completed").select("batch_fk")
    rows = t.batches.select(F.col("uid").alias("batch_fk")).unionByName(done).withColumn("metadata", F.lit('{"new":true}'))
    return upserts.insert_if_absent(t.fetch_outbox.select("batch_fk", "metadata"), rows, ["batch_fk"])


@query("""select r.request_id, case when r.state = 'completed' then coalesce(r.raw_result_locator, k.new_locator) else r.raw_result_locator end
      as raw_result_locator from requests r left join request_tokens k on k.request_id = r.request_id""", "requests", "request_tokens")
def set_if_null(t: Inputs) -> DataFrame:
    return upserts.set_if_null(
        t.requests, t.request_tokens, "request_id", "raw_result_locator", "new_locator", F.col("state") == "completed",
    ).select("request_id", "raw_result_locator")


@query("""select event_id, batch_fk, event_type from batch_events union all
    select -1 - event_id as event_id, batch_fk, case when status = 'expired' then 'poll_error' else 'polled' end as event_type from provider_reports""",
       "batch_events", "provider_reports")
def append_events(t: Inputs) -> DataFrame:
    status = variants.provider_status("status", "error_file_id")
    new = t.provider_reports.select(
        (-1 - F.col("event_id")).alias("event_id"), "batch_fk", F.when(status["is_error"], "poll_error").otherwise("polled").alias("event_type"))
    return upserts.append(t.batch_events.select("event_id", "batch_fk", "event_type"), new)


# ---- states, numbering, audits --------------------------------------------------------

@query("select production_id, state, count(*) as n from requests group by production_id, state", "requests")
def state_counts(t: Inputs) -> DataFrame:
    return events.state_counts(t.requests)


@query("""select request_id, event_id, state, occurred_at from (select *, row_number() over (partition by request_id
    order by occurred_at desc, event_id desc) as rn from request_events) x where rn = 1""", "request_events")
def latest_request_event(t: Inputs) -> DataFrame:
    return events.latest_event(t.request_events.select("request_id", "event_id", "state", "occurred_at"), "request_id")


@query("""select request_id, production_id, row_number() over (partition by production_id order by created_at, request_id) as item_index
    from requests""", "requests")
def item_index(t: Inputs) -> DataFrame:
    return results.item_index(t.requests.select("request_id", "production_id", "created_at"), "production_id", ["created_at", "request_id"]).drop("created_at")


_UNIQUE = [(t, ",".join(k)) for t, keys in (schemas.UNIQUE_KEYS | {"link_log": [("request_fk", "batch_fk")]}).items() for k in keys]


@query(" union all ".join(
    f"select '{t}' as table_name, '{k}' as key_columns, cast(sum(n) as bigint) as n_rows, count(*) as n_keys, "
    f"count(*) filter (where n > 1) as n_repeated from (select count(*) as n from {t} group by {k}) q" for t, k in _UNIQUE),
    *dict.fromkeys(t for t, _ in _UNIQUE))
def uniqueness_audit(t: Inputs) -> DataFrame:
    keys: dict[str, list[tuple[str, ...]]] = {}
    for table, cols in _UNIQUE:
        keys.setdefault(table, []).append(tuple(cols.split(",")))
    return audit.uniqueness_audit({n: getattr(t, n) for n in keys}, keys)


_FKS = schemas.FOREIGN_KEYS
_FK_TABLES = tuple(dict.fromkeys(t for fk in _FKS for t in (fk[0], fk[2])))


@query(" union all ".join(
    f"select '{c}' as child_table, '{cc}' as child_column, {cc} as missing_key, count(*) as n_rows from {c} "
    f"where {cc} is not null and {cc} not in (select {pc} from {p}) group by {cc}" for c, cc, p, pc in _FKS), *_FK_TABLES)
def fk_audit(t: Inputs) -> DataFrame:
    return audit.fk_audit({n: getattr(t, n) for n in _FK_TABLES}, _FKS)


@query("""with gone as (select request_id as rid from requests where production_id in (select production_id from deleted_productions))
    select 'productions' as table_name, count(*) as n from productions where production_id not in (select production_id from deleted_productions)
    union all select 'requests', count(*) from requests where request_id not in (select rid from gone)
    union all select 'request_events', count(*) from request_events where request_id not in (select rid from gone)
    union all select 'batch_requests', count(*) from batch_requests where request_fk not in (select rid from gone)
    union all select 'request_results', count(*) from request_results where request_fk not in (select rid from gone)""",
       "productions", "requests", "request_events", "batch_requests", "request_results", "deleted_productions")
def cascade_delete(t: Inputs) -> DataFrame:
    names = ("productions", "requests", "request_events", "batch_requests", "request_results")
    left = audit.cascade_delete({n: getattr(t, n) for n in names}, productions=t.deleted_productions)
    counts = [left[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""select 'batches' as table_name, count(*) as n from batches where uid not in (select uid from deleted_batches)
    union all select 'batch_events', count(*) from batch_events where batch_fk not in (select uid from deleted_batches)
    union all select 'batch_requests', count(*) from batch_requests where batch_fk not in (select uid from deleted_batches)
    union all select 'request_results', count(*) from request_results where batch_fk not in (select uid from deleted_batches)
    union all select 'fetch_outbox', count(*) from fetch_outbox where batch_fk not in (select uid from deleted_batches)""",
       "batches", "batch_events", "batch_requests", "request_results", "fetch_outbox", "deleted_batches")
def cascade_delete_batches(t: Inputs) -> DataFrame:
    names = ("batches", "batch_events", "batch_requests", "request_results", "fetch_outbox")
    left = audit.cascade_delete({n: getattr(t, n) for n in names}, batches=t.deleted_batches)
    counts = [left[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""select state as value, count(*) as n from state_log
    where state is null or state not in ('entered', 'submitted', 'cancelled', 'completed') group by state""", "state_log")
def state_domain_check(t: Inputs) -> DataFrame:
    return audit.state_domain_check(t.state_log, "state")


# ---- provider statuses and event details ----------------------------------------------

@query("""select event_id, case when status = 'expired' then 'error' else status end as status,
      case when status in ('failed', 'cancelled') then coalesce(error_file_id, '') end as reason, status = 'expired' as is_error
    from provider_reports""", "provider_reports")
def map_provider_status(t: Inputs) -> DataFrame:
    s = variants.provider_status("status", "error_file_id")
    return t.provider_reports.select("event_id", s["status"].alias("status"), s["reason"].alias("reason"), s["is_error"].alias("is_error"))


@query("""select event_id, case when status = 'expired' then 'error' else status end as status_text,
      case when status in ('failed', 'cancelled') then coalesce(error_file_id, '') end as reason from provider_reports""", "provider_reports")
def provider_status_text(t: Inputs) -> DataFrame:
    s = variants.provider_status("status", "error_file_id")
    polled = details.polled(variants.provider_status_text(s["status"]), s["reason"])
    return t.provider_reports.select("event_id", polled.alias("_d")).select(
        "event_id", F.get_json_object("_d", "$.provider_status").alias("status_text"), F.get_json_object("_d", "$.reason").alias("reason"))


_DETAIL_ROWS = [
    # event, three checked values
    ("entered", "'tpl'", "provider_batch_id", "'7'"), ("batch_submitted", "uid", "provider_batch_id", "'10'"),
    ("submitted", "uid", "provider_batch_id", "null"), ("submit_failed", "'E1'", "provider_batch_id", "null"),
    ("polled", "'failed'", "poll_claim_token", "null"), ("provider_terminal", "'failed'", "poll_claim_token", "null"),
    ("poll_error", "'E2'", "provider_batch_id", "null"), ("batch_terminal", "uid", "'cancelled'", "poll_claim_token"),
    ("raw_fetched", "uid", "provider_batch_id", "'12'"), ("answer_materialized", "uid", "'5'", "null"),
    ("answers_materialized", "'3'", "'4'", "'7'"), ("fetch_failed", "'E3'", "provider_batch_id", "null")]


@query(" union all ".join(
    f"select uid, '{e}' as event, cast({a} as varchar) as f1, cast({b} as varchar) as f2, cast({c} as varchar) as f3 from batches"
    for e, a, b, c in _DETAIL_ROWS), "batches")
def event_details(t: Inputs) -> DataFrame:
    uid, pid, reason = F.col("uid"), F.col("provider_batch_id"), F.col("poll_claim_token")
    lit = F.lit
    built = {
        "entered": (details.entered(lit("tpl"), pid, lit(7), lit("h")), "template_name", "source_name", "item_index"),
        "batch_submitted": (details.batch_submitted(uid, pid, lit(10)), "batch_uid", "provider_batch_id", "request_count"),
        "submitted": (details.request_submitted(uid, pid), "batch_uid", "provider_batch_id", "none"),
        "submit_failed": (details.submit_failed(lit("E1"), pid), "error_code", "error_message", "none"),
        "polled": (details.polled(lit("failed"), reason), "provider_status", "reason", "none"),
        "provider_terminal": (details.provider_terminal(lit("failed"), reason), "terminal_kind", "reason", "none"),
        "poll_error": (details.poll_error(lit("E2"), pid), "error_code", "error_message", "none"),
        "batch_terminal": (details.batch_terminal(uid, lit("cancelled"), reason), "batch_uid", "terminal_kind", "reason"),
        "raw_fetched": (details.raw_fetched(uid, pid, lit(12)), "batch_uid", "raw_result_locator", "bytes"),
        "answer_materialized": (details.answer_materialized(uid, lit('{"k":5}')), "batch_uid", "metadata.k", "none"),
        "answers_materialized": (details.answers_materialized(lit(3), lit(4), lit(7)), "ok_count", "missing_count", "batch_request_count"),
        "fetch_failed": (details.fetch_failed(lit("E3"), pid), "error_code", "error_message", "none")}
    rows = F.explode(F.array(*[
        F.struct(d.alias("d"), *[lit(f"$.{f}").alias(f"p{i}") for i, f in enumerate(fs)]) for d, *fs in built.values()]))
    got = t.batches.select("uid", rows.alias("r"))
    return got.select(
        "uid", F.get_json_object("r.d", "$.event").alias("event"),
        *[F.expr(f"get_json_object(r.d, r.p{i})").alias(f"f{i + 1}") for i in range(3)])


# ---- responses ------------------------------------------------------------------------

@query("""select d.eid as request_eid, a.uid as response_uid, a.kind, a.content, c.eid as asset_eid, cast(c.size as varchar) as asset_size
    from cresponse a join crequest d on a.crequest_fk = d.uid left join assetresponselink b on a.uid = b.response_fk
    left join asset c on b.asset_fk = c.uid""", "cresponse", "crequest", "assetresponselink", "asset")
def response_resolution(t: Inputs) -> DataFrame:
    return responses.response_resolution(t.cresponse, t.crequest, t.assetresponselink, t.asset).withColumn(
        "asset_size", F.col("asset_size").cast("string")).drop("request_uid")


@query("""select d.eid as request_eid, e.created_at, cast(e.kind as int) as kind, e.notes from crequest d join reqexec e on e.crequest_fk = d.uid
    where e.kind <> 1""", "crequest", "reqexec")
def failed_executions(t: Inputs) -> DataFrame:
    return responses.failed_executions(t.crequest, t.reqexec).drop("request_uid")


_KINDS = """with res as (select d.eid as request_eid, a.kind, a.content, c.eid as asset_eid, c.size as asset_size from cresponse a
      join crequest d on a.crequest_fk = d.uid left join assetresponselink b on a.uid = b.response_fk left join asset c on b.asset_fk = c.uid),
    bad as (select request_eid, notes from (select d.eid as request_eid, e.notes, row_number() over (partition by d.eid order by e.created_at, e.notes) as rn
      from crequest d join reqexec e on e.crequest_fk = d.uid where e.kind <> 1) x where rn = 1),
    outcomes as (select d.eid as request_eid, case when r.request_eid is null then case when bad.notes is null then 'no_response_yet' else 'aborted' end
        when r.kind in (1, 2, 3, 4) then case when r.content is null then 'no_response_yet' else 'text_block' end
        when r.asset_eid is null then 'no_response_yet' else 'asset' end as outcome, r.content, r.asset_eid, r.asset_size, bad.notes
      from crequest d left join res r on r.request_eid = d.eid left join bad on bad.request_eid = d.eid)"""
_RESPONSE_INPUTS = ("cresponse", "crequest", "assetresponselink", "asset", "reqexec")


def _outcomes(t: Inputs) -> DataFrame:
    return responses.outcomes(t.crequest, t.cresponse, t.assetresponselink, t.asset, t.reqexec)


@query(_KINDS + """ select request_eid, outcome, case when outcome in ('text_block', 'asset') then content end as content,
      case when outcome = 'asset' then asset_eid end as asset_eid, case when outcome = 'asset' then cast(asset_size as varchar) end as asset_size,
      case when outcome = 'aborted' then notes end as note from outcomes""", *_RESPONSE_INPUTS)
def response_kind(t: Inputs) -> DataFrame:
    return _outcomes(t).withColumn("asset_size", F.col("asset_size").cast("string"))


@query(_KINDS + " select request_eid, case when outcome = 'aborted' then 'ABORT' else 'OK' end as status from outcomes", *_RESPONSE_INPUTS)
def invocation_status(t: Inputs) -> DataFrame:
    return _outcomes(t).select("request_eid", responses.invocation_status(F.col("outcome")).alias("status"))


@query(_KINDS + """ select request_eid, request_eid as response_eid, outcome as kind, case when outcome in ('text_block', 'asset') then content end as content,
      case when outcome = 'aborted' then 'ABORT' else 'OK' end as status from outcomes""", *_RESPONSE_INPUTS)
def response_json(t: Inputs) -> DataFrame:
    shape = "responseEId string, result struct<kind:string,content:string>, status string"
    j = _outcomes(t).select("request_eid", F.from_json(responses.response_json(), shape).alias("j"))
    return j.select("request_eid", F.col("j.responseEId").alias("response_eid"), "j.result.kind", "j.result.content", "j.status")


@query("""select c.uid, count(x.reason) = 0 as is_valid from cconnection c left join ccancel x on x.connection_fk = c.uid group by c.uid""",
       "cconnection", "ccancel")
def valid_connections(t: Inputs) -> DataFrame:
    return responses.valid_connections(t.cconnection, t.ccancel)


@query("""with h as (select uid, account_fk, md5('call|' || cast(uid as varchar)) as h, state from (select o_orderkey as uid, o_custkey as account_fk, o_orderstatus as state from orders) o)
    select uid, account_fk, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] as eid,
      case when state = 'F' then 5 else 1 end as kind, case when state = 'F' then 'failed' end as notes from h""")
def record_invocation(t: Inputs) -> DataFrame:
    calls = t.orders.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("account_fk"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"))
    recorded = responses.record_invocations(calls.withColumn("function", F.lit("call")), ["function", "uid"], AS_OF)
    ended = responses.end_transactions(calls).select(F.col("crequest_fk").alias("uid"), "kind", "notes")
    return recorded.join(ended, "uid").select("uid", "account_fk", "eid", "kind", "notes")


