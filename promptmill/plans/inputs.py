"""Pipeline tables derived from the star-schema test tables.

Every entry is SQL that Spark and DuckDB read alike, so a registered query and its SQL twin
start from the same rows. Whole tables and whole texts are used throughout; ``%`` appears only
to spread rows over the cases of a column.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from promptmill.session import ship_package
from promptmill.sources.tables import load_table, spread
from promptmill.streaming.runs import read_stream

AS_OF = "2001-08-02 00:00:00"

_V = "varchar(40)"
_ESCAPED = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
_CID = f"'00000000-0000-4000-8000-' || lpad(cast(doc_id as {_V}), 12, '0')"
_DELIM = "'-*-*-*-*-*-*-*-*-*-' || chr(10)"

# name -> (inputs it reads, SQL)
INPUTS: dict[str, tuple[tuple[str, ...], str]] = {
    # ---- life cycle ---------------------------------------------------------------
    "requests": ((), f"""
        select cast(o_orderkey as {_V}) as request_id, cast(o_custkey as {_V}) as production_id, o_orderkey as item_index,
          '{{"priority":"' || o_orderpriority || '"}}' as item_meta,
          o_orderpriority || ' order ' || cast(o_orderkey as {_V}) as request_text,
          case o_orderstatus when 'O' then 'entered' when 'P' then 'submitted' else 'completed' end as state,
          case when o_orderkey % 4 = 0 then 'loc' || cast(o_custkey as {_V}) end as raw_result_locator,
          case when o_orderkey % 6 = 0 then 'loc' || cast(o_custkey + 5 as {_V}) end as final_result_locator,
          case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then o_orderdate + interval '1' day
            else o_orderdate + interval '4000' day end as submit_claimed_until,
          case when o_orderkey % 3 <> 0 then 'node' || cast(o_custkey % 5 as {_V}) end as submit_claimed_by,
          case when o_orderkey % 3 <> 0 then 'tok' || cast(o_orderkey % 7 as {_V}) end as submit_claim_token,
          o_orderdate as created_at, o_orderdate + interval '2' day as updated_at from orders"""),
    "request_tokens": ((), f"""
        select cast(o_orderkey as {_V}) as request_id, 'tok' || cast(o_orderkey % 14 as {_V}) as submit_claim_token,
          'new' || cast(o_custkey as {_V}) as new_locator from orders"""),
    "batches": ((), f"""
        select cast(l_suppkey as {_V}) as uid, 'pb_' || cast(l_suppkey as {_V}) as provider_batch_id,
          case when l_suppkey % 4 = 0 then min(l_shipdate) + interval '3000' day
            when l_suppkey % 4 = 1 then min(l_shipdate) + interval '2000' day end as poll_claimed_until,
          case when l_suppkey % 4 < 2 then 'node1' end as poll_claimed_by,
          case when l_suppkey % 4 < 2 then 'ptok' || cast(l_suppkey % 3 as {_V}) end as poll_claim_token,
          min(l_shipdate) as created_at from lineitem group by l_suppkey"""),
    "poll_tokens": ((), f"""
        select cast(s_suppkey as {_V}) as uid, 'ptok' || cast(s_suppkey % 6 as {_V}) as poll_claim_token from supplier"""),
    "batch_requests": ((), f"""
        select distinct cast(l_orderkey as {_V}) as request_fk, cast(l_suppkey as {_V}) as batch_fk from lineitem"""),
    "link_log": ((), f"""
        select cast(l_orderkey as {_V}) as request_fk, cast(l_suppkey as {_V}) as batch_fk from lineitem"""),
    "batch_events": ((), f"""
        select event_id, cast(user_id as {_V}) as batch_fk,
          case when event_type = 'purchase' and value >= 190 then 'completed' when event_type = 'error' and value >= 195 then 'failed'
            when event_type = 'signup' and value >= 200 then 'cancelled' when event_type in ('view', 'purchase') then 'polled'
            when event_type = 'click' then 'poll_error' else 'submitted' end as event_type,
          props as details, ts as occurred_at from events"""),
    "request_events": ((), f"""
        select event_id, cast(user_id * 100 as {_V}) as request_id,
          case when event_type = 'purchase' and value >= 150 then 'completed' when event_type = 'error' and value >= 190 then 'cancelled'
            when event_type in ('view', 'signup') then 'entered' else 'submitted' end as state,
          props as details, ts as occurred_at from events"""),
    "fetch_outbox": ((), f"""
        select cast(user_id as {_V}) as batch_fk, '{{}}' as metadata,
          case when user_id % 3 = 1 then min(ts) - interval '9000' day when user_id % 3 = 2 then min(ts) end as fetch_claimed_until,
          case when user_id % 3 > 0 then 'node2' end as fetch_claimed_by,
          case when user_id % 3 > 0 then 'ftok' || cast(user_id % 5 as {_V}) end as fetch_claim_token,
          min(ts) as created_at from events group by user_id"""),
    "outbox_tokens": ((), f"""
        select cast(c_custkey as {_V}) as batch_fk, 'ftok' || cast(c_custkey % 10 as {_V}) as fetch_claim_token from customer"""),
    "request_results": ((), f"""
        select cast(l_orderkey as {_V}) as request_fk, cast(l_suppkey as {_V}) as batch_fk, min(l_shipdate) as created_at,
          '{{"n":' || cast(count(*) as {_V}) || '}}' as metadata, 'old ' || cast(min(l_partkey) as {_V}) as content
        from lineitem where l_returnflag = 'R' group by l_orderkey, l_suppkey"""),
    "answers": ((), f"""
        select cast(l_orderkey as {_V}) as request_fk,
          cast(case when l_linenumber = 7 then l_suppkey + 1 else l_suppkey end as {_V}) as batch_fk, l_linenumber as line_no, l_partkey as part_no,
          case when l_partkey % 5 > 0 then '{{"part":' || cast(l_partkey as {_V}) || '}}' end as metadata,
          case when l_partkey % 7 > 0 then 'new ' || cast(l_partkey as {_V}) end as content
        from lineitem where l_linestatus = 'F'"""),
    "deleted_productions": ((), f"""
        select cast(c_custkey as {_V}) as production_id from customer where c_mktsegment = 'BUILDING'"""),
    "productions": ((), f"""
        select cast(c_custkey as {_V}) as production_id, c_name as production_name, 'tpl' || cast(c_nationkey as {_V}) as template_id,
          'src' || cast(c_custkey % 60 as {_V}) as source_id from customer"""),
    "s3_objects": ((), f"""
        select 'loc' || cast(c_custkey as {_V}) as locator, 'source' as kind from customer where c_custkey % 11 > 0
        union all select 'loc' || cast(n_nationkey as {_V}) as locator, 'template' as kind from nation"""),
    "asset_templates": ((), f"""
        select 'tpl' || cast(n_nationkey as {_V}) as template_id, n_name as template_name, 'loc' || cast(n_nationkey * 30 as {_V}) as s3_locator
        from nation where n_nationkey <> 7 union all select 'tpl3' as template_id, r_name as template_name, 'loc' || cast(r_regionkey * 0 + 1 as {_V}) as s3_locator from region"""),
    "asset_sources": ((), f"""
        select 'src' || cast(s_suppkey % 50 as {_V}) as source_id, s_name as source_name, 'loc' || cast(s_suppkey as {_V}) as s3_locator from supplier"""),
    "deleted_batches": ((), f"select cast(s_suppkey as {_V}) as uid from supplier where s_suppkey % 3 = 1"),
    "state_log": ((), """
        select event_id, case event_type when 'error' then 'lost' when 'signup' then null when 'view' then 'submitted' else 'entered' end as state from events"""),
    # ---- provider reports -----------------------------------------------------------
    "provider_reports": ((), f"""
        select event_id, cast(user_id as {_V}) as batch_fk,
          case when event_type = 'purchase' and value >= 190 then 'completed' when event_type = 'error' and value >= 195 then 'failed'
            when event_type = 'signup' and value >= 200 then 'cancelled' when event_type = 'view' then 'in_progress'
            when event_type = 'click' then 'expired' when event_type = 'signup' then 'validating' else 'finalizing' end as status,
          case when value >= 197 then 'file_' || cast(event_id as {_V}) end as error_file_id, ts as occurred_at from events"""),
    "status_payloads": (("provider_reports",), f"""
        select event_id, case when status = 'expired' then '{{"id":"pb_' || batch_fk || '","request_counts":{{"total":3}}}}'
          when status = 'finalizing' then 'no json'
          else '{{"id":"pb_' || batch_fk || '","status":"' || status || '","output_file_id":null,"error_file_id":'
            || coalesce('"' || error_file_id || '"', 'null') || ',"request_counts":{{"total":' || cast(event_id as {_V}) || '}}}}' end as payload
        from provider_reports"""),
    "submit_payloads": ((), f"""
        select o_orderkey as uid, case o_orderstatus when 'F' then '{{"id":"b' || cast(o_orderkey as {_V}) || '"}}'
          else '{{"id":"b' || cast(o_orderkey as {_V}) || '","status":"validating","completed_at":' || cast(o_custkey as {_V})
            || ',"request_counts":{{"total":' || cast(o_orderkey + 5 as {_V}) || ',"completed":' || cast(o_orderkey as {_V}) || ',"failed":5}},'
            || '"usage":{{"input_tokens":7,"input_tokens_details":{{"cached_tokens":3}},"output_tokens":' || cast(o_custkey as {_V})
            || ',"total_tokens":' || cast(o_custkey + 7 as {_V}) || '}}}}' end as payload from orders"""),
    "upload_payloads": ((), f"""
        select doc_id, '{{"id":"file-' || cast(doc_id as {_V}) || '","object":"file","bytes":' || cast(n_chars as {_V})
          || ',"created_at":1700000000,"expires_at":1800000000,"filename":"' || source || '.jsonl"'
          || case when lang = 'de' then '' else ',"purpose":"batch"' end || '}}' as payload from documents"""),
    # ---- responses ------------------------------------------------------------------
    "crequest": ((), f"""
        select o_orderkey as uid, 'inv' || cast(o_orderkey as {_V}) as eid, o_custkey as account_fk from orders"""),
    "cresponse": ((), f"""
        select o_orderkey as uid, o_orderkey as crequest_fk, cast(1 + o_orderkey % 6 as int) as kind,
          case when o_custkey % 4 > 0 then o_orderpriority end as content from orders where o_orderstatus = 'F'"""),
    "assetresponselink": (("cresponse",), """
        select uid as response_fk, uid % 3000 as asset_fk from cresponse where kind > 3"""),
    "asset": ((), f"""
        select p_partkey as uid, 'asset' || cast(p_partkey as {_V}) as eid, cast(p_size as bigint) as size from part"""),
    "reqexec": ((), f"""
        select l_orderkey as crequest_fk, case when l_returnflag = 'A' and l_linenumber > 5 then 5 else 1 end as kind,
          'part ' || cast(l_partkey as {_V}) as notes, l_shipdate as created_at from lineitem"""),
    "cconnection": ((), "select c_custkey as uid, c_name as token from customer"),
    "ccancel": ((), """
        select o_custkey as connection_fk, case when o_orderpriority = '1-URGENT' then o_orderpriority end as reason from orders"""),
    "asset_versions": ((), f"""
        select cast(l_partkey as {_V}) as eid, l_orderkey * 100 + l_linenumber * 10 as version, max(l_quantity) as size
        from lineitem group by l_partkey, l_orderkey, l_linenumber"""),
    # ---- result lines ---------------------------------------------------------------
    "result_files": ((), f"""
        select doc_id, source as batch_fk, case doc_id % 8
          when 0 then '{{"custom_id":"' || cid || '","response":{{"body":{{"output_text":"' || a || '"}}}}}}'
          when 1 then '{{"custom_id":"' || cid || '","response":{{"body":{{"output_text":["' || a || '",3," tail "]}}}}}}'
          when 2 then '{{"custom_id":"' || cid || '","response":{{"status_code":200,"body":{{"output":[{{"type":"reasoning","summary":[]}},'
            || '{{"type":"message","content":[{{"type":"output_text","text":" ' || a || ' "}},{{"text":7}}]}},4],"usage":{{"input_tokens":30,"output_tokens":'
            || cast(doc_id as {_V}) || ',"total_tokens":' || cast(doc_id + 30 as {_V}) || '}}}}}},"error":null}}'
          when 3 then 'bad{{' || a
          when 4 then '{{"response":{{"body":{{"output_text":"' || a || '"}}}}}}'
          when 5 then '{{"custom_id":"' || cid || '","response":{{"body":{{"output_text":"   "}}}}}}'
          when 6 then '{{"custom_id":"' || cid || '","output_text":"' || a || '"}}'
          else '{{"custom_id":"x' || cid || '","response":{{"body":{{"output_text":"' || a
            || '","output":[{{"type":"message","content":[{{"text":"more"}}]}}]}}}}}}' end as line
        from (select doc_id, source, {_CID} as cid, 'answer ' || cast(doc_id as {_V}) || ' from ' || source || ': '
                || {_ESCAPED.format("text")} as a from documents) d"""),
    "existing_results": ((), f"select {_CID} as custom_id from labels"),
    "payloads": ((), f"""
        select doc_id, case doc_id % 5
          when 0 then '{{"results":[{{"custom_id":"' || cid || '","output_text":"' || a || '","metadata":{{"k":1}}}},{{"custom_id":"zz","content":"x"}}]}}'
          when 1 then '{{"results":null,"data":[{{"custom_id":"' || cid || '","text":"' || a || '"}},{{"custom_id":"' || cid || '"}}]}}'
          when 2 then '{{"items":[{{"custom_id":"' || cid || '","response":{{"output_text":"' || a || '"}}}},{{"custom_id":"' || cid
            || '","response":{{"text":"t"}}}}]}}'
          when 3 then '{{"results":[{{"custom_id":"' || cid || '","content":"' || a || '"}}],"items":[]}}'
          else '{{"other":[]}}' end as payload
        from (select doc_id, {_CID} as cid, {_ESCAPED.format("text")} as a from documents) d"""),
    # ---- corpora --------------------------------------------------------------------
    "corpora": ((), f"""
        select doc_id, source, lang, text, 'preamble' || chr(10) || {_DELIM} || 'id = ' || cast(doc_id as {_V}) || chr(10) || '# note' || chr(10)
          || 'meta.source = "' || source || '"' || chr(10) || 'tags = [1, "x", true]' || chr(10) || ' -*-*-*-*-*-*-*-*-*- ' || chr(10)
          || text || chr(10) || {_DELIM} || 'lang = ' || lang || chr(10)
          || case when doc_id % 10 = 9 then '' when doc_id % 10 = 8 then 'no value' || chr(10) || {_DELIM}
             else {_DELIM} || 'second body' end as corpus from documents"""),
    "prompt_files": ((), f"""
        select doc_id, cast(doc_id as {_V}) || ': Title: ' || text || chr(10) || chr(10) || 'no number here' || chr(10) || '  ' || chr(10)
          || '7 : ' || lang || chr(13) || chr(10) || chr(13) || chr(10) || '9:' as prompts from documents"""),
    # ---- references, pages, characters ----------------------------------------------
    "ref_texts": ((), f"""
        select doc_id, 'See ' || case doc_id % 4 when 0 then 'DOC-' when 1 then 'SEC–MKT-' when 2 then 'XTAX‑' else 'GOV-x GOV-' end
          || lpad(cast(doc_id % 100 as {_V}), 2, '0') || case doc_id % 3 when 0 then '..12' when 1 then '/03' else '..7' end || ' sch. '
          || replace(replace(text, '. ', '. SEC-' || lpad(cast(doc_id % 100 as {_V}), 2, '0') || '..07/11 '), ', ', ', PLY—041 ') as text
        from documents"""),
    "ref_pages": ((), f"""
        select page_id, replace(replace(html, '<article>', '<article><p>See <em>DOC-' || lpad(cast(page_id % 100 as {_V}), 2, '0')
          || '..09</em> and <span class="DLV-ref">TAX-01</span></p>'), '<ul>', '<ul class="MY-6 nav">') as html from pages"""),
    "digit_texts": ((), "select doc_id, translate(text, '0123456789*#', '₀₁₂₃₄₅₆₇₈₉●☐') || ' ✓' as text from documents"),
    "math_texts": ((), """
        select doc_id, '$^' || source || '$ ' || replace(replace(text, '. ', '$ and $' || chr(92) || 'd{2}$ '), ', ', ' $a+b$ $' || chr(92) || '(x$ ') as text
        from documents"""),
    # ---- streams --------------------------------------------------------------------
    "result_stream": (("result_files",), "select batch_fk, doc_id as line_no, line from result_files"),
    "result_links": ((), f"select {_CID} as request_fk, source as batch_fk from documents where lang <> 'de'"),
    "ready_batches": (("provider_reports",), "select batch_fk, occurred_at from provider_reports where status = 'completed'"),
    "lease_grants": ((), f"""
        select event_id, cast(user_id as {_V}) as request_id, 'w' || cast(event_id as {_V}) as claim_token, ts as claimed_at
        from events where event_type = 'view'"""),
    "late_updates": ((), f"""
        select event_id, cast(user_id as {_V}) as request_id, 'w' || cast(event_id as {_V}) as claim_token
        from events where event_type in ('view', 'click')"""),
    "lease_log": ((), f"""
        select event_id, cast(user_id as {_V}) as request_id, case event_type when 'view' then 'claim' else 'update' end as kind,
          'w' || cast(event_id % 3 as {_V}) as claim_token, ts as occurred_at from events where event_type in ('view', 'click')"""),
    # ---- objects --------------------------------------------------------------------
    "stored": ((), """
        select doc_id, lang || '/' || source as name, text from documents"""),
    "object_keys": ((), "select page_id, url as key, cast(length(html) as bigint) as bytes from pages"),
    "key_prefixes": ((), """
        select distinct 'http://' || split_part(split_part(url, '//', 2), '/', 1) || '/' as prefix from pages
        union all select 'http://th' as prefix"""),
    "result_paths": ((), f"""
        select doc_id, case lang when 'de' then 'results/' || {_CID} || '.html' when 'fr' then 'results/old.json/' || {_CID} || '.json'
          else 'results/' || {_CID} || '.json' end as path from documents"""),
    "encoded": (("stored",), """
        select doc_id, case doc_id % 9 when 8 then '*' || b else replace(b, 'A', 'A' || chr(10) || ' -') end as content64
        from encoded_base"""),
}
SPARK_ONLY = {"encoded_base": "select doc_id, base64(encode(text, 'UTF-8')) as b from stored"}
DUCKDB_ONLY = {"encoded_base": "select doc_id, to_base64(encode(text)) as b from stored"}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

TEXT_TABLES = ("documents", "pages")


def _closure(names: tuple[str, ...], seen: dict[str, None]) -> dict[str, None]:
    for n in names:
        if n not in seen:
            _closure(INPUTS[n][0], seen)
            if n == "encoded":
                seen["encoded_base"] = None
            seen[n] = None
    return seen


def with_clause(names: tuple[str, ...], dialect: dict[str, str]) -> str:
    order = _closure(names, {})
    return "with " + ",\n".join(f"{n} as ({dialect[n] if n in dialect else INPUTS[n][1]})" for n in order) if order else ""


def duckdb_sql(sql: str, *names: str) -> str:
    """A DuckDB statement over derived inputs; ``sql`` may bring its own WITH list."""
    head, sql = with_clause(names, DUCKDB_ONLY), sql.strip()
    if head and sql.lower().startswith("with "):
        return head + ",\n" + sql[5:]
    return f"{head}\n{sql}" if head else sql


class Inputs:
    """Derived inputs as DataFrames: ``Inputs(spark, sf_dir).requests``; test tables by name as well."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        """A test table; the tables of texts are dealt over all cores when they come in few splits."""
        df = load_table(self.spark, self.sf_dir, name)
        return spread(df) if name in TEXT_TABLES else df

    def _derive(self, name: str, streamed: str | None, files_per_trigger: int | None = None) -> DataFrame:
        head, views = with_clause((name,), SPARK_ONLY), []
        for t in TABLES:  # under names of their own, so that no view of the user is touched
            if re.search(rf"\b(?:from|join) {t}\b", head):
                path = f"{self.sf_dir}/{t}.parquet"
                df = read_stream(self.spark, path, files_per_trigger=files_per_trigger) if t == streamed else self.table(t)
                views.append(f"promptmill_{t}_{uuid.uuid4().hex}")
                df.createOrReplaceTempView(views[-1])
                head = re.sub(rf"\b(from|join) {t}\b", rf"\1 {views[-1]}", head)
        found = self.spark.sql(f"{head}\nselect * from {name}")
        for view in views:
            self.spark.catalog.dropTempView(view)
        return found

    def stream(self, name: str, source: str, files_per_trigger: int | None = None) -> DataFrame:
        """A derived input over ``source`` read as a stream."""
        return self._derive(name, source, files_per_trigger)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in INPUTS:
            raise AttributeError(name)
        return self._derive(name, None)
