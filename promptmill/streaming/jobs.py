"""Submit, poll and fetch as streaming jobs, plus de-duplication, state and lease streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptmill import schemas
from promptmill.functions import details, variants
from promptmill.functions.text import as_time, lease_free, stable_uuid
from promptmill.operators import claims, events, results
from promptmill.operators.joins import join_hot
from promptmill.plans.production import submission_lines
from promptmill.session import ship_package
from promptmill.sources import jsonl
from promptmill.sources.tables import conform
from promptmill.sources.versions import VersionedTable
from promptmill.streaming.runs import current, mark, marks, query_id, read_epochs, run, together, write_epoch

LINKS = "request_fk string, batch_fk string, created_at timestamp_ntz"
SENT = "batch_uid string, provider_batch_id string, error_code string, error_message string"


def _now(as_of):
    """A point in time: given, or asked for at each step."""
    return as_of() if callable(as_of) else as_of


class SubmitLog:
    """The steps of a submitting job, kept in its output and not in the stream's checkpoint.

    A step takes up a micro-batch, or only what waits. It first writes what it will send (``seen``, ``request_lines``)
    and a mark in ``planned``; then it sends, writes what became of it, and a mark in ``done``. Steps are numbered
    one behind the other and a number is used again until it is planned, so whatever a lost step left
    is written over. A planned step that is not done is finished first, from what it wrote and under its own batch ids, before any
    other. Only ``done`` steps count as state, whether they have rows or not.
    """

    def __init__(self, out: str, schema, as_of, send=None, **line_options):
        self.out, self.schema, self.as_of, self.send, self.line_options = out, schema, as_of, send, line_options

    def step(self, df: DataFrame | None, spark: SparkSession, query: str | None = None, micro_batch: int | None = None) -> None:
        """Work off ``df`` (nothing new for None) and what waits; a micro-batch that is already done changes nothing."""
        done = self.finish(spark)
        if micro_batch is not None and not done.where((F.col("query") == query) & (F.col("micro_batch") == micro_batch)).isEmpty():
            return
        number = self._last(done) + 1
        self._plan(spark.createDataFrame([], self.schema) if df is None else df, number, query, micro_batch)
        self._carry_out(spark, number)

    def finish(self, spark: SparkSession) -> DataFrame:
        """Carry out a step that was planned and then lost; all marks of steps that are done."""
        done = marks(spark, f"{self.out}/done")
        last = self._last(done)
        if not marks(spark, f"{self.out}/planned").where(F.col("epoch") == last + 1).isEmpty():
            self._carry_out(spark, last + 1)
            return marks(spark, f"{self.out}/done")
        return done

    def waiting(self, spark: SparkSession) -> DataFrame:
        """Requests that could not be sent by the last step that is done."""
        last = self._last(marks(spark, f"{self.out}/done"))
        return read_epochs(spark, f"{self.out}/pending", self.schema).where(F.col("epoch") == last).drop("epoch")

    @staticmethod
    def _last(done: DataFrame) -> int:
        last = done.agg(F.max("epoch")).first()[0]
        return -1 if last is None else last

    def _plan(self, df: DataFrame, number: int, query: str | None, micro_batch: int | None) -> None:
        spark, out, as_of = df.sparkSession, self.out, _now(self.as_of)
        last = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.coalesce("updated_at", "created_at"), "created_at"))
        known = df.unionByName(self.waiting(spark)).groupBy("request_id").agg(last.alias("_r")).select("_r.*")
        # sent before, or seen in another state: neither is ever sent again
        sent = read_epochs(spark, f"{out}/batch_requests", _struct(spark, LINKS), before=number).select(F.col("request_fk").alias("request_id"))
        closed = read_epochs(spark, f"{out}/seen", self.schema, before=number).where(F.col("state") != "entered").select("request_id")
        over = sent.unionByName(closed).join(known.select("request_id"), "request_id", "left_semi").distinct()
        seen = write_epoch(known.join(over, "request_id", "left_anti"), f"{out}/seen", number)
        free = claims.claimable_requests(seen, as_of).select("request_id", "request_text", "created_at")
        lines = submission_lines(free, ["created_at", "request_id"], **self.line_options)
        write_epoch(lines.withColumn("batch_uid", stable_uuid(F.lit("batch"), F.lit(number), "batch_no")), f"{out}/request_lines", number)
        mark(spark, f"{out}/planned", number, query, micro_batch, as_time(as_of))

    def _carry_out(self, spark: SparkSession, number: int) -> None:
        out = self.out
        read = lambda name: spark.read.parquet(f"{out}/{name}/epoch={number}")
        plan, lines, seen = read("planned").first(), read("request_lines"), read("seen")
        now = as_time(plan["at"])
        counted = lines.groupBy("batch_uid").agg(F.count(F.lit(1)).alias("n"))
        if self.send is None:
            none = F.lit(None).cast("string")
            sent = counted.select("batch_uid", F.concat(F.lit("pb_"), "batch_uid").alias("provider_batch_id"), none.alias("error_code"), none.alias("error_message"))
            lost = None
        else:  # asked once; what was answered is what counts from here on
            sent = write_epoch(conform(self.send(lines), _struct(spark, SENT)), f"{out}/sent", number)
            lost = lines.join(sent.where(F.col("error_code").isNotNull()), "batch_uid").select("request_id", "error_code", "error_message")
        taken = sent.where(F.col("error_code").isNull()).select("batch_uid", "provider_batch_id")
        whole = counted.join(taken, "batch_uid")
        write_epoch(whole.select(F.col("batch_uid").alias("uid"), "provider_batch_id", now.alias("created_at")), f"{out}/batches", number)
        write_epoch(whole.select(
            F.xxhash64("batch_uid", F.lit("submitted")).alias("event_id"), F.col("batch_uid").alias("batch_fk"), F.lit("submitted").alias("event_type"),
            details.batch_submitted(F.col("batch_uid"), F.col("provider_batch_id"), F.col("n")).alias("details"), now.alias("occurred_at")), f"{out}/batch_events", number)
        members = lines.select("request_id", "batch_uid").join(taken, "batch_uid")
        history = members.select(
            F.xxhash64("request_id", F.lit("submitted")).alias("event_id"), "request_id", F.lit("submitted").alias("state"),
            details.request_submitted(F.col("batch_uid"), F.col("provider_batch_id")).alias("details"), now.alias("occurred_at"))
        wait = seen.where((F.col("state") == "entered") & ~lease_free("submit_claimed_until", plan["at"]))
        if lost is not None:
            history = history.unionByName(lost.select(
                F.xxhash64("request_id", F.lit("submit_failed"), F.lit(number)).alias("event_id"), "request_id", F.lit("entered").alias("state"),
                details.submit_failed(F.col("error_code"), F.col("error_message")).alias("details"), now.alias("occurred_at")))
            released = F.lit(None).cast(self.schema["submit_claimed_until"].dataType)
            wait = wait.unionByName(seen.join(lost, "request_id", "left_semi").withColumn("submit_claimed_until", released))
        write_epoch(history, f"{out}/request_events", number)
        write_epoch(members.select(
            F.col("request_id").alias("request_fk"), F.col("batch_uid").alias("batch_fk"), now.alias("created_at")), f"{out}/batch_requests", number)
        write_epoch(wait.select(*self.schema.names), f"{out}/pending", number)
        mark(spark, f"{out}/done", number, plan["query"], plan["micro_batch"], now)


def submitted(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of a submitting job (``request_lines``, ``batches``, ``batch_requests``, ...) as its finished steps have it."""
    done = marks(spark, f"{out}/done").select("epoch")
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").join(F.broadcast(done), "epoch", "left_semi")  # one row per step


def submit_stream(requests: DataFrame, out: str, checkpoint: str, as_of, system_text: str = "", model: str = "gpt-5", effort: str | None = None,
                  every: str | None = None, send=None) -> StreamingQuery:
    """Entered, lease-free requests become batches of request lines with their links and events.

    Requests under a lease wait; every micro-batch takes them up again, and without ``every`` they are tried once more
    at the end. A request with a link, or seen in another state, is never submitted again. ``send`` gets the request lines
    of a step (batch_uid, pos, request_id, line, ...) and returns (batch_uid, provider_batch_id, error_code, error_message): a
    batch with an error leaves ``submit_failed`` events, its requests lose their lease and wait. It may be
    asked again for the same lines under the same batch ids after a crash. ``as_of`` may be a function, asked at each step.
    What has been done is kept in ``SubmitLog``; ``submitted`` reads the tables.
    """
    wanted = [c for c in ("request_id", "request_text", "state", "submit_claimed_until", "created_at", "updated_at") if c in requests.columns]
    narrow = requests.select(*wanted)
    if "updated_at" not in wanted:
        narrow = narrow.withColumn("updated_at", F.col("created_at"))
    log = SubmitLog(out, narrow.schema, as_of, send, system_text=system_text, model=model, effort=effort)

    def step(df: DataFrame, epoch: int) -> None:
        log.step(df, df.sparkSession, query_id(df.sparkSession, checkpoint), epoch)

    query = run(narrow, step, checkpoint, every=every)
    if not every:
        spark = requests.sparkSession
        log.finish(spark)
        if not log.waiting(spark).where(lease_free("submit_claimed_until", _now(as_of))).isEmpty():
            log.step(None, spark)
    return query


TERMINAL = "batch_fk string, occurred_at timestamp_ntz, event_id bigint, status string, reason string"


def poll_stream(reports: DataFrame, batch_requests, requests, out: str, checkpoint: str, every: str | None = None, batches=None,
                ttl: int = schemas.CLAIM_TTL_SECONDS) -> StreamingQuery:
    """Provider reports (event_id, batch_fk, status, error_file_id, occurred_at) become batch events.

    The first terminal report of a batch ends it: a completed batch enters the outbox, a failed or
    cancelled one cancels its submitted requests. Reports after that one are not recorded.
    ``batch_requests``, ``requests`` and ``batches`` are read at each step (path, function of the session, or a
    fixed DataFrame). With ``batches`` a report must bring the batch's ``poll_claim_token``: stale ones go
    to ``stale_reports``; ``poll_leases`` has what becomes of the lease, kept by a running state and
    ended by an error and by a terminal one.
    """
    def step(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        if batches is not None:
            held = current(spark, batches).select(F.col("uid").alias("batch_fk"), "poll_claim_token").where(F.col("poll_claim_token").isNotNull())
            write_epoch(df.join(held, ["batch_fk", "poll_claim_token"], "left_anti"), f"{out}/stale_reports", epoch)
            df = df.join(held, ["batch_fk", "poll_claim_token"], "left_semi")
        touched = df.select("batch_fk").distinct()
        ended = read_epochs(spark, f"{out}/terminal", _struct(spark, TERMINAL), before=epoch).join(touched, "batch_fk", "left_semi").select("batch_fk").distinct()
        status = variants.provider_status("status", "error_file_id")
        mapped = df.select("event_id", "batch_fk", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), status.alias("s")).select(
            "event_id", "batch_fk", "occurred_at", "s.status", "s.reason", "s.is_error")
        seen = join_hot(mapped, ended, ["batch_fk"], "left_anti")
        first = seen.where(claims.is_terminal_event("status")).groupBy("batch_fk").agg(
            F.min(F.struct("occurred_at", "event_id", "status", "reason")).alias("t")).select("batch_fk", "t.*")
        terminal = write_epoch(first, f"{out}/terminal", epoch)

        ends = terminal.select("batch_fk", F.struct("occurred_at", "event_id").alias("_end"))
        kept = write_epoch(join_hot(seen, ends, ["batch_fk"], "left").where(
            F.col("_end").isNull() | (F.struct("occurred_at", "event_id") <= F.col("_end"))).drop("_end"), f"{out}/polls", epoch)
        polled = kept.select(
            "event_id", "batch_fk", F.when(F.col("is_error"), "poll_error").otherwise("polled").alias("event_type"),
            F.when(F.col("is_error"), details.poll_error(F.lit("PROVIDER"), F.lit("unknown batch status"))).otherwise(
                details.polled(variants.provider_status_text(F.col("status")), F.col("reason"))).alias("details"), "occurred_at")
        closing = terminal.select(
            F.xxhash64("batch_fk", "status").alias("event_id"), "batch_fk", F.col("status").alias("event_type"),
            details.provider_terminal(F.col("status"), F.col("reason")).alias("details"), "occurred_at")
        write_epoch(polled.unionByName(closing), f"{out}/batch_events", epoch)
        write_epoch(terminal.where(F.col("status") == "completed").select("batch_fk", F.lit("{}").alias("metadata"), F.col("occurred_at").alias("created_at")), f"{out}/fetch_outbox", epoch)
        if batches is not None:
            last = kept.groupBy("batch_fk").agg(F.max_by(F.struct("is_error", "status", "occurred_at"), F.struct("occurred_at", "event_id")).alias("l"))
            over = F.col("l.is_error") | claims.is_terminal_event("l.status")
            write_epoch(last.select("batch_fk", F.when(~over, F.col("l.occurred_at") + F.make_dt_interval(secs=F.lit(ttl))).alias("poll_claimed_until")), f"{out}/poll_leases", epoch)

        stopped = terminal.where(F.col("status").isin("cancelled", "failed")).select("batch_fk", "status", "reason", "occurred_at")
        links = join_hot(current(spark, batch_requests).select("request_fk", "batch_fk"), stopped, ["batch_fk"])
        submitted = current(spark, requests).where(F.col("state") == "submitted").select(F.col("request_id").alias("request_fk"))
        write_epoch(links.join(submitted, "request_fk", "left_semi").select(
            F.xxhash64("request_fk", "batch_fk", F.lit("cancelled")).alias("event_id"), F.col("request_fk").alias("request_id"), F.lit("cancelled").alias("state"),
            details.batch_terminal(F.col("batch_fk"), F.col("status"), F.col("reason")).alias("details"), "occurred_at"), f"{out}/request_events", epoch)

    return run(reports, step, checkpoint, every=every)


ANSWERS = "batch_fk string, request_fk string, metadata string, content string, line_no bigint"
REJECTS = "batch_fk string, line_no bigint, reason string, request_fk string"
FETCHED = "batch_fk string, line_no bigint, bytes bigint"
COMPLETED = "event_id bigint, request_id string, state string, details string, occurred_at timestamp_ntz"


def fetch_stream(lines: DataFrame, batch_requests, out: str, checkpoint: str, every: str | None = None, requests=None, outbox=None,
                 as_of="1970-01-01 00:00:00", backoff: int = schemas.ERROR_BACKOFF_SECONDS) -> StreamingQuery:
    """Result lines (batch_fk, line_no, line) become answers, rejects, events and outbox removals.

    Tables are read at each step (path, function of the session, or a fixed DataFrame), so links and
    requests that are added later are seen. All counts of a batch are taken over its answers so far:
    a later ``answers_materialized`` or ``raw_fetched`` row replaces an earlier one (``current_batch_events``).
    A ``submitted`` request (any, without ``requests``) is completed once. A batch leaves the ``outbox`` (any
    batch, without one) when no answer of it is missing. Lines with a non-null ``error`` column report a failed fetch: a
    ``fetch_failed`` event, and the batch may be fetched again after ``backoff`` seconds (``fetch_leases``).
    """
    files = "line_no" not in lines.columns
    if "error" not in lines.columns:
        lines = lines.withColumn("error", F.lit(None).cast("string"))

    def step(df: DataFrame, epoch: int) -> None:
        spark, now = df.sparkSession, as_time(_now(as_of))
        if files:
            df = jsonl.number_result_lines(df.drop("error")).withColumn("error", F.lit(None).cast("string"))
        links = current(spark, batch_requests).select("batch_fk", "request_fk")
        failed = df.where(F.col("error").isNotNull()).groupBy("batch_fk").agg(F.max("error").alias("error"))
        put = lambda rows, name: lambda: write_epoch(rows, f"{out}/{name}", epoch)
        extracted = jsonl.with_main_text(df.where(F.col("error").isNull()).drop("error")).withColumn("answer_class", results.answer_class())
        failed, fixed = together(spark, put(failed, "failures"), put(extracted.select("batch_fk", "line_no", "line", "custom_id", "content", "answer_class"), "lines"))
        good = fixed.where(F.col("answer_class") == "good").select(
            "batch_fk", F.lower("custom_id").alias("request_fk"), F.lit("null").alias("metadata"), "content", "line_no")
        answers = results.allowed_answers(good, links).select("batch_fk", "request_fk", "metadata", "content", "line_no")
        foreign = good.join(links, ["batch_fk", "request_fk"], "left_anti").select("batch_fk", "line_no", F.lit("foreign_request").alias("reason"), "request_fk")
        bad = fixed.where(F.col("answer_class") != "good").select(
            "batch_fk", "line_no", F.col("answer_class").alias("reason"), F.lower("custom_id").alias("request_fk"))
        size = (F.octet_length(F.encode("line", "UTF-8")) + 1).cast("bigint")
        answers, batches, _, _ = together(
            spark, put(answers, "answers"), put(fixed.select("batch_fk").distinct(), "touched"), put(bad.unionByName(foreign), "rejects"),
            put(fixed.groupBy("batch_fk", "line_no").agg(F.max(size).alias("bytes")), "fetched"))

        done = answers.select("request_fk", "batch_fk").distinct()
        if requests is not None:
            done = done.join(current(spark, requests).where(F.col("state") == "submitted").select(F.col("request_id").alias("request_fk")), "request_fk", "left_semi")
        fresh = done.groupBy("request_fk").agg(F.min("batch_fk").alias("batch_fk"))
        before = read_epochs(spark, f"{out}/request_events", _struct(spark, COMPLETED), before=epoch).select(F.col("request_id").alias("request_fk"))
        fresh = fresh.join(before.join(fresh.select("request_fk"), "request_fk", "left_semi").distinct(), "request_fk", "left_anti")
        completed = fresh.select(
            F.xxhash64("request_fk", F.lit("completed")).alias("event_id"), F.col("request_fk").alias("request_id"), F.lit("completed").alias("state"),
            details.answer_materialized(F.col("batch_fk"), F.lit("null")).alias("details"), now.alias("occurred_at"))

        so_far = join_hot(read_epochs(spark, f"{out}/answers", _struct(spark, ANSWERS), before=epoch + 1), batches, ["batch_fk"], "left_semi")
        members = join_hot(links, batches, ["batch_fk"], "left_semi")
        fetched_so_far = join_hot(read_epochs(spark, f"{out}/fetched", _struct(spark, FETCHED), before=epoch + 1), batches, ["batch_fk"], "left_semi")
        raw = fetched_so_far.groupBy("batch_fk", "line_no").agg(F.max("bytes").alias("bytes")).groupBy("batch_fk").agg(F.sum("bytes").alias("bytes")).select(
            "batch_fk", stable_uuid(F.lit("raw"), "batch_fk").alias("locator"), F.lit("raw_result").alias("kind"), "bytes",
            F.lit("application/json").alias("content_type"))
        counts, raw, _ = together(
            spark, put(batches.join(results.answers_materialized(so_far, members), "batch_fk", "left").fillna(0), "counts"), put(raw, "s3_objects"),
            put(completed, "request_events"))
        materialized = counts.select(
            F.xxhash64("batch_fk", F.lit("answers_materialized")).alias("event_id"), "batch_fk", F.lit("answers_materialized").alias("event_type"),
            details.answers_materialized(F.col("ok_count"), F.col("missing_count"), F.col("batch_request_count")).alias("details"), now.alias("occurred_at"))
        if files:
            whole = counts.select("batch_fk")
        else:
            refused = join_hot(read_epochs(spark, f"{out}/rejects", _struct(spark, REJECTS), before=epoch + 1), batches, ["batch_fk"], "left_semi")
            handled = so_far.select("batch_fk", "request_fk").unionByName(refused.select("batch_fk", "request_fk")).distinct()
            open_batches = members.join(handled, ["batch_fk", "request_fk"], "left_anti").select("batch_fk").distinct()
            whole = counts.select("batch_fk").join(open_batches, "batch_fk", "left_anti")
        if outbox is not None:
            whole = whole.join(current(spark, outbox).select("batch_fk").distinct(), "batch_fk", "left_semi")
        fetched = raw.select(
            F.xxhash64("batch_fk", F.lit("raw_fetched")).alias("event_id"), "batch_fk", F.lit("raw_fetched").alias("event_type"),
            details.raw_fetched(F.col("batch_fk"), F.col("locator"), F.col("bytes")).alias("details"), now.alias("occurred_at"))
        lost = failed.select(
            F.xxhash64("batch_fk", F.lit("fetch_failed"), F.lit(epoch)).alias("event_id"), "batch_fk", F.lit("fetch_failed").alias("event_type"),
            details.fetch_failed(F.lit("FETCH"), F.col("error")).alias("details"), now.alias("occurred_at"))
        together(
            spark, put(whole, "outbox_done"), put(fetched.unionByName(materialized).unionByName(lost), "batch_events"),
            put(failed.select("batch_fk", (now + F.make_dt_interval(secs=F.lit(backoff))).alias("fetch_claimed_until")), "fetch_leases"))

    return run(lines, step, checkpoint, every=every)


def current_results(spark: SparkSession, out: str) -> DataFrame:
    """Last answer per (batch, request)."""
    rows = read_epochs(spark, f"{out}/answers", _struct(spark, ANSWERS))
    return rows.groupBy("batch_fk", "request_fk").agg(
        F.max_by(F.struct("metadata", "content"), F.struct("epoch", "line_no")).alias("_r")).select("batch_fk", "request_fk", "_r.*")


def current_batch_events(spark: SparkSession, out: str) -> DataFrame:
    """Batch events of a fetch job; of rows with one event id the latest counts."""
    rows = spark.read.parquet(f"{out}/batch_events")
    return rows.groupBy("event_id").agg(
        F.max_by(F.struct("batch_fk", "event_type", "details", "occurred_at"), "epoch").alias("_r")).select("event_id", "_r.*")


def current_rejects(spark: SparkSession, out: str) -> DataFrame:
    """Rejected lines, each once however often it was delivered, without those that were accepted later."""
    rows = spark.read.parquet(f"{out}/rejects").select("batch_fk", "line_no", "reason").distinct()
    accepted = read_epochs(spark, f"{out}/answers", _struct(spark, ANSWERS)).select("batch_fk", "line_no").distinct()
    return rows.join(accepted, ["batch_fk", "line_no"], "left_anti")


READY = "batch_fk string, occurred_at timestamp_ntz"


def outbox_table(spark: SparkSession, out: str) -> VersionedTable:
    """The outbox that ``outbox_dedupe_stream`` keeps below ``out``: ``outbox_table(spark, out).read()``."""
    return VersionedTable(spark, out, _struct(spark, READY))


def outbox_dedupe_stream(ready: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One outbox row per batch, although a fast and a durable path may both deliver it, however late.

    The outbox is a versioned table: a micro-batch is one commit, a repeated one changes nothing, and small folders are
    brought together as it grows, so a step reads few files however many came before.
    """
    def step(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        table, stream = outbox_table(spark, out), query_id(spark, checkpoint)
        first = df.groupBy("batch_fk").agg(F.min(F.col("occurred_at").cast("timestamp_ntz")).alias("occurred_at"))
        before = table.read().select("batch_fk")
        table.append(first.join(before.join(first.select("batch_fk"), "batch_fk", "left_semi"), "batch_fk", "left_anti"), stream, epoch)
        if table.compact() is not None:
            table.vacuum()

    return run(ready, step, checkpoint, every=every)


STATES = "request_id string, state string"


def request_state_stream(request_events: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Current state per request, folded from its events; each micro-batch writes what changed.

    The state store holds two small values per request and rows are combined before the shuffle.
    """
    terminal, latest = events.folded_state()
    folded = request_events.groupBy("request_id").agg(terminal.alias("_t"), latest.alias("_l")).select("request_id", F.coalesce("_t", "_l").alias("state"))
    return run(folded, lambda df, epoch: write_epoch(df, f"{out}/states", epoch), checkpoint, "update", every)


def current_states(spark: SparkSession, out: str) -> DataFrame:
    rows = read_epochs(spark, f"{out}/states", _struct(spark, STATES))
    return rows.groupBy("request_id").agg(F.max_by("state", "epoch").alias("state"))


LEASES = "request_id string, claim_token string, claimed_at timestamp_ntz, claimed_until timestamp_ntz"


def lease_stream(grants: DataFrame, out: str, checkpoint: str, ttl: int = schemas.CLAIM_TTL_SECONDS, every: str | None = None) -> StreamingQuery:
    """Current lease per request from a stream of grants (request_id, claim_token, claimed_at, event_id)."""
    last = grants.groupBy("request_id").agg(
        F.max(F.struct("claimed_at", "event_id", "claim_token")).alias("_l")).select("request_id", "_l.claim_token", "_l.claimed_at")
    held = last.withColumn("claimed_until", F.col("claimed_at") + F.make_dt_interval(secs=F.lit(ttl)))
    return run(held, lambda df, epoch: write_epoch(df, f"{out}/leases", epoch), checkpoint, "update", every)


def current_leases(spark: SparkSession, out: str, as_of) -> DataFrame:
    """Latest lease per request and whether it has run out."""
    rows = read_epochs(spark, f"{out}/leases", _struct(spark, LEASES))
    last = rows.groupBy("request_id").agg(F.max_by(F.struct("claim_token", "claimed_at", "claimed_until"), "epoch").alias("_l")).select("request_id", "_l.*")
    return last.withColumn("is_free", lease_free("claimed_until", as_of))


def judge_updates(updates: DataFrame, leases: DataFrame) -> DataFrame:
    """Mark updates (request_id, claim_token) ``accepted`` when their token is the current one; late workers' are not."""
    current = leases.select("request_id", F.col("claim_token").alias("_token"))
    return updates.join(current, "request_id", "left").withColumn("accepted", F.coalesce(F.col("claim_token") == F.col("_token"), F.lit(False))).drop("_token")


# times as microseconds, so that no session time zone comes in
_TOLD = "request_id string, event_type string, claim_token string, event_id bigint, us bigint"
_HELD = "token string, event_id bigint, until bigint, open boolean, waiting array<struct<us:bigint,event_id:bigint,kind:string,token:string>>"


def _lease_of(ttl: int):
    """The state function of ``lease_event_stream``: one lease and one timer per request."""
    def apply(key, batches, state):
        token, number, until, held, waiting = state.get if state.exists else (None, None, None, False, [])
        now = 1000 * state.getCurrentWatermarkMs()
        waiting = [tuple(r) for r in waiting]
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["kind"], pdf["claim_token"], strict=True)
        waiting.sort(key=lambda r: r[:2])
        told = []

        def run_out(before):
            nonlocal held
            if held and until < before:
                held = False
                told.append((key[0], "expired", token, number, until))

        while waiting and waiting[0][0] < now:
            us, event, kind, mark = waiting.pop(0)
            run_out(us)
            if kind == "claim":
                token, number, until, held = mark, event, us + 1_000_000 * ttl, True
                told.append((key[0], "claimed", mark, event, us))
            else:  # by token alone: who was late but not replaced is still the one
                told.append((key[0], "accepted" if token is not None and mark == token else "stale", mark, event, us))
        run_out(now)
        state.update((token, number, until, held, waiting))
        due = [r[0] for r in waiting[:1]] + [until] * held
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000, now // 1000 + 1))
        yield pd.DataFrame(told, columns=["request_id", "event_type", "claim_token", "event_id", "us"])

    return apply


def lease_event_stream(log: DataFrame, out: str, checkpoint: str, ttl: int = schemas.CLAIM_TTL_SECONDS, delay: str = "10 minutes", every: str | None = None) -> StreamingQuery:
    """Claims and updates (request_id, kind ``claim`` or ``update``, claim_token, event_id, occurred_at) become lease events in the order of their time.

    A row counts once the watermark (the latest time seen less ``delay``) has passed it, so micro-batches in any order within
    the delay give the same events; what comes later than that is dropped by the stream and counted in its progress. A claim
    (``claimed``) replaces the lease there is. A timer per lease, at its end, gives ``expired`` unless a claim came before. An update is ``accepted``
    while its token is the one last claimed, run out or not, else ``stale``.
    """
    ship_package(log.sparkSession)
    at = F.col("occurred_at").cast("timestamp")
    timed = log.select("request_id", "kind", "claim_token", "event_id", at.alias("occurred_at"), F.unix_micros(at).alias("us")).withWatermark("occurred_at", delay)
    told = timed.groupBy("request_id").applyInPandasWithState(_lease_of(ttl), _TOLD, _HELD, "append", "EventTimeTimeout")
    named = told.withColumn("occurred_at", F.timestamp_micros("us")).drop("us")
    return run(named, lambda df, epoch: write_epoch(df, f"{out}/lease_events", epoch), checkpoint, "append", every)


def _struct(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema
