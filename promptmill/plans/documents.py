"""Registered queries: corpora, templates, request lines, result lines, pages, objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill import schemas
from promptmill.functions import hashing, refs, requests, template, variants
from promptmill.functions.text import WS_CHARS, is_uuid, once, stable_uuid
from promptmill.operators import numbering, pages, results
from promptmill.plans import commands, production
from promptmill.plans.inputs import AS_OF, Inputs
from promptmill.plans.registry import query
from promptmill.session import cut_lineage, shared_dir
from promptmill.sources import corpus, jsonl, objects

_WS = f"'{WS_CHARS}'"
_NL = "chr(10)"
_FNV = """printf('%016x', list_reduce(list_prepend(14695981039346656037::uhugeint,
    list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::uhugeint)),
    lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::ubigint)"""


def uuid_sql(expr: str) -> str:
    return f"regexp_replace(md5({expr}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


# ---- hashing and request lines ----------------------------------------------------------

@query(f"select doc_id, {_FNV.format('text')} as fnv from documents")
def fnv1a64_hex(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", hashing.fnv1a64_hex("text").alias("fnv"))


def _document_batches(t: Inputs) -> DataFrame:
    return numbering.fixed_groups(t.documents.select("doc_id", "text"), schemas.BATCH_SIZE, ["doc_id"])


@query(f"""with b as (select cast((rn - 1) // 10 as bigint) as batch_no, text, rn from (select text, row_number() over (order by doc_id) as rn from documents) x),
    j as (select batch_no, {_NL} || string_agg(text, {_NL} order by rn) as joined, count(*) as request_count from b group by batch_no)
    select batch_no, request_count, 'doc-fnv1a64-' || {_FNV.format('joined')} as cache_key from j""")
def batch_cache_key(t: Inputs) -> DataFrame:
    return production.cache_keys(_document_batches(t), "batch_no", "pos", "text")


@query("""with b as (select doc_id, text, (rn - 1) // 10 as batch_no from (select doc_id, text, row_number() over (order by doc_id) as rn from documents) x)
    select cast(batch_no as bigint) as batch_no, count(*) as request_count, cast(sum(length(text)) as bigint) as prompt_chars from b group by 1""")
def submission_plan(t: Inputs) -> DataFrame:
    """Flagship: documents to request lines, numbered batches, cache keys, and per-batch sizes read back from the lines."""
    lines = production.submission_lines(
        t.documents.select(stable_uuid("doc_id").alias("request_id"), F.col("text").alias("request_text"), "doc_id"),
        ["doc_id"], system_text="You draft documents.", model="gpt-5", effort="high")
    return lines.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum(F.length(F.get_json_object("line", "$.body.input[1].content[0].text"))).cast("bigint").alias("prompt_chars"))


_LINE = (
    "custom_id string, method string, url string, body struct<model:string,prompt_cache_key:string,max_output_tokens:string,"
    "input:array<struct<role:string,content:array<struct<type:string,text:string>>>>,reasoning:struct<effort:string>>")


def _read_back(lines: DataFrame, *keys: str) -> DataFrame:
    """The fields of request lines, each line parsed once."""
    part = lambda i, p: F.get(F.col("j.body.input"), F.lit(i))[p]
    return lines.select(*keys, once(F.from_json("line", _LINE)).alias("j")).select(
        *keys, "j.custom_id", "j.method", "j.url", "j.body.model", F.col("j.body.prompt_cache_key").alias("cache_key"),
        F.col("j.body.max_output_tokens").alias("max_tokens"), F.get(part(0, "content"), F.lit(0))["text"].alias("system_text"),
        F.get(part(1, "content"), F.lit(0))["text"].alias("user_text"), part(1, "role").alias("user_role"), F.col("j.body.reasoning.effort").alias("effort"))


@query("""select request_id, request_id as custom_id, 'POST' as method, '/v1/responses' as url, 'gpt-5' as model, 'key-' || production_id as cache_key,
      '200000' as max_tokens, 'system' as system_text, request_text as user_text, 'user' as user_role,
      case when state = 'entered' then 'high' end as effort from requests""", "requests")
def request_line(t: Inputs) -> DataFrame:
    line = requests.request_line(
        F.col("request_id"), F.lit("system"), F.col("request_text"), F.concat(F.lit("key-"), "production_id"), F.lit("gpt-5"),
        F.when(F.col("state") == "entered", "high"))
    return _read_back(t.requests.select("request_id", line.alias("line")), "request_id")


@query(f"""select c.doc_id, c.turn, 'q_010802_000000_' || case when c.turn < 1000 then lpad(cast(c.turn + 1 as varchar), 4, '0') else cast(c.turn + 1 as varchar) end as custom_id,
      'POST' as method, '/v1/responses' as url, 'gpt-5' as model, 'configured' as cache_key, '200000' as max_tokens,
      'pre' || {_NL} || d.text || {_NL} || {_NL} || {_NL} || 'Use these project details as the authoritative context for your responses.' || {_NL} || 'post' as system_text,
      c.text as user_text, 'user' as user_role, 'high' as effort
    from (select conv_id as doc_id, turn, text from conversations) c join documents d on d.doc_id = c.doc_id""")
def request_line_doc(t: Inputs) -> DataFrame:
    """Each turn of a conversation asked over the document of the same number."""
    turns = t.conversations.select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("prompt"))
    moment = F.date_format(F.lit(AS_OF).cast("timestamp_ntz"), "yyMMdd_HHmmss")
    line = requests.request_line(
        requests.numbered_id(moment, F.col("turn") + 1), requests.document_system_text(F.col("text"), "pre\n", "post"),
        F.col("prompt"), F.lit("configured"), F.lit("gpt-5"), F.lit("high"))
    lines = turns.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "turn", line.alias("line"))
    return _read_back(lines, "doc_id", "turn")


# ---- corpora ----------------------------------------------------------------------------

_ITEMS = f"""items as (select doc_id, source, lang, 1 as item_index,
      'id = ' || cast(doc_id as varchar) || {_NL} || '# note' || {_NL} || 'meta.source = "' || source || '"' || {_NL} || 'tags = [1, "x", true]' || {_NL} as header_toml,
      text || {_NL} as body from documents where doc_id % 10 < 8
    union all select doc_id, source, lang, 2, 'lang = ' || lang || {_NL}, 'second body' || {_NL} from documents where doc_id % 10 < 8)"""
_SPLIT = r"(?m)^[\t\x0B-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*-(?:\*-){9}[\t\x0B-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*(?:\n|\z)"
_SEGMENTS = f"""seg as (select doc_id, regexp_split_to_array(corpus, '{_SPLIT}') as s from corpora),
    nums as (select doc_id, s, unnest(generate_series(1, (len(s) - 1) // 2)) as item_index from seg
      where len(s) % 2 = 1 and not list_contains(list_transform(flatten(list_transform(generate_series(1, (len(s) - 1) // 2), lambda i: string_split(s[2 * i], {_NL}))),
        lambda ln: trim(ln, {_WS}) <> '' and not starts_with(trim(ln, {_WS}), '#') and not contains(ln, '=')), true)),
    cut as (select doc_id, item_index, s[2 * item_index] as h, s[2 * item_index + 1] as b from nums),
    split_items as (select doc_id, cast(item_index as int) as item_index, case when h = '' or ends_with(h, {_NL}) then h else h || {_NL} end as header_toml,
      case when b = '' or ends_with(b, {_NL}) then b else b || {_NL} end as body from cut)"""


@query(f"with {_SEGMENTS} select * from split_items", "corpora")
def source_items(t: Inputs) -> DataFrame:
    return corpus.source_items(t.corpora.select("doc_id", "corpus")).items


@query("""select doc_id, case when doc_id % 10 = 8 then 'header line without ''=''' else 'header opened but never closed' end as reason
    from documents where doc_id % 10 > 7""")
def source_rejects(t: Inputs) -> DataFrame:
    return corpus.source_items(t.corpora.select("doc_id", "corpus")).rejects


@query(f"""with {_SEGMENTS},
    ls as (select doc_id, item_index, string_split(header_toml, {_NL}) as l from split_items),
    ln as (select doc_id, item_index, unnest(l) as line, unnest(generate_series(1, len(l))) as line_no from ls),
    kv as (select doc_id, item_index, cast(line_no as int) as line_no, trim(split_part(line, '=', 1), {_WS}) as key, trim(substr(line, strpos(line, '=') + 1), {_WS}) as v
      from ln where trim(line, {_WS}) <> '' and not starts_with(trim(line, {_WS}), '#'))
    select doc_id, item_index, line_no, key, case when v like '"%"' then 'string' when v in ('true', 'false') then 'boolean' when v like '[%]' then 'array'
        when regexp_matches(v, '^-?[0-9]+$') then 'number' else 'string' end as vtype,
      case when v like '"%"' or v in ('true', 'false') then v when v like '[%]' then replace(v, ', ', ',') when regexp_matches(v, '^-?[0-9]+$') then cast(cast(v as bigint) as varchar)
        else '"' || v || '"' end as json from kv""", "corpora")
def front_matter_entries(t: Inputs) -> DataFrame:
    return corpus.front_matter_entries(corpus.source_items(t.corpora.select("doc_id", "corpus")).items)


@query(f"""with {_ITEMS} select doc_id, item_index, case when item_index = 1
      then '{{"id":' || cast(doc_id as varchar) || ',"meta":{{"source":"' || source || '"}},"tags":[1,"x",true]}}' else '{{"lang":"' || lang || '"}}' end as item_meta from items""")
def item_meta(t: Inputs) -> DataFrame:
    items = corpus.source_items(t.corpora.select("doc_id", "corpus")).items
    return corpus.with_item_meta(items).select("doc_id", "item_index", "item_meta")


TEMPLATE = (
    "Production {{ production.name }} item {{ index }} [{{ meta.lang }}{{ meta.meta.source }}]{% if meta.id %} id {{ meta.id }}{% else %} no id{% endif %}"
    "{% for t in meta.tags %}<{{ t }}>{% endfor %}{{ unknown }}: {{ item.content }}")


@query(f"""with {_ITEMS} select doc_id, item_index, 'Production p' || cast(doc_id as varchar) || ' item ' || cast(item_index as varchar) || ' ['
      || case when item_index = 1 then source || case doc_id when 0 then '] no id' else '] id ' || cast(doc_id as varchar) end || '<1><x><true>' else lang || '] no id' end || ': ' || body as request_text from items""")
def render_template(t: Inputs) -> DataFrame:
    items = corpus.with_item_meta(corpus.source_items(t.corpora.select("doc_id", "corpus")).items)
    look = template.item_context(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.col("item_index"), F.col("body"), F.col("item_meta"), F.col("header_toml"))
    return items.select("doc_id", "item_index", template.to_column(TEMPLATE, look).alias("request_text"))


_PROD = uuid_sql("'production|p' || cast(doc_id as varchar)")


@query(f"""with {_ITEMS}, keyed as (select {_PROD} as production_id, doc_id, item_index, body from items)
    select production_id, item_index, {uuid_sql("'request|' || production_id || '|' || cast(item_index as varchar)")} as request_id, 'entered' as state,
      'Draft ' || cast(item_index as varchar) || ': ' || body as request_text, 'tpl' as template_name, 'doc' || cast(doc_id as varchar) as source_name from keyed""")
def insert_production(t: Inputs) -> DataFrame:
    corpora = t.corpora.select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("production_name"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_name"), "corpus")
    new = production.new_productions(corpora, "tpl", "Draft {{ index }}: {{ text }}", AS_OF)
    events = new.request_events.select(
        "request_id", F.get_json_object("details", "$.template_name").alias("template_name"), F.get_json_object("details", "$.source_name").alias("source_name"))
    return new.requests.join(events, "request_id").select(
        "production_id", "item_index", "request_id", "state", "request_text", "template_name", "source_name")


@query(f"""select doc_id, doc_id as number, trim(substr(prompts, strpos(prompts, ':') + 1, strpos(prompts, {_NL} || {_NL} || 'no number') - strpos(prompts, ':') - 1), {_WS}) as title
    from prompt_files union all select doc_id, 7, lang from prompt_files join (select doc_id, lang from documents) d using (doc_id)""", "prompt_files")
def prompt_blocks(t: Inputs) -> DataFrame:
    return corpus.prompt_blocks(t.prompt_files.select("doc_id", "prompts")).select("doc_id", "number", "title")


@query(f"""with p as (select doc_id, 1 as idx, 'Generate a first version for item ' || cast(doc_id as varchar) || ', "' ||
        trim(substr(prompts, strpos(prompts, ':') + 1, strpos(prompts, {_NL} || {_NL} || 'no number') - strpos(prompts, ':') - 1), {_WS}) || '"' as prompt from prompt_files
      union all select doc_id, 2, 'Generate a first version for item 7, "' || lang || '"' from documents),
    h as materialized (select doc_id, text, {_FNV.format('text')} as fnv from documents)
    select doc_id, cast(idx as bigint) as index, 'q_010802_000000_' || lpad(cast(idx as varchar), 4, '0') as custom_id, prompt, 'doc-fnv1a64-' || fnv as cache_key,
      'pre' || text || {_NL} || {_NL} || {_NL} || 'Use these project details as the authoritative context for your responses.' || {_NL} || 'post' as system_text
    from p join h using (doc_id)""", "prompt_files")
def load_requests(t: Inputs) -> DataFrame:
    runs = t.prompt_files.join(t.documents.select("doc_id", F.col("text").alias("document")), "doc_id")
    loaded = commands.load_requests(runs, "doc_id", AS_OF, "gpt-5", prefix="pre", postfix="post")
    return _read_back(loaded.lines, "doc_id", "index", "prompt").select("doc_id", "index", "custom_id", "prompt", "cache_key", "system_text")


# ---- result lines -----------------------------------------------------------------------

_DECODED = f"""d0 as (select doc_id, batch_fk, line, json_valid(line) as line_ok, case when json_valid(line) then line::json end as j from result_files where line <> ''),
    d1 as (select *, case when json_type(j, '$.custom_id') = 'VARCHAR' then j ->> '$.custom_id' end as custom_id,
      case when json_type(j, '$.response') = 'OBJECT' then json_extract(j, '$.response.body') else j end as body from d0),
    d2 as (select *, case json_type(body, '$.output_text') when 'VARCHAR' then [body ->> '$.output_text'] when 'ARRAY' then
        list_transform(list_filter((body -> '$.output_text')::json[], lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') else [] end as direct,
      case when json_type(body, '$.output') = 'ARRAY' then list_filter((body -> '$.output')::json[], lambda x: json_type(x, '$.type') = 'VARCHAR' and (x ->> '$.type') = 'message') else [] end as items from d1),
    d3 as (select *, flatten(list_transform(items, lambda it: case when json_type(it, '$.content') = 'ARRAY' then
        list_transform(list_filter((it -> '$.content')::json[], lambda c: json_type(c, '$.text') = 'VARCHAR'), lambda c: c ->> '$.text') else [] end)) as nested from d2),
    decoded as (select doc_id, batch_fk, line, line_ok, custom_id, j, body, case when json_type(body) = 'OBJECT' then
      nullif(trim(array_to_string(list_filter(list_transform(list_concat(direct, nested), lambda x: trim(x, {_WS})), lambda x: x <> ''), {_NL} || {_NL}), {_WS}), '') end as content from d3)"""
_UUID = "regexp_matches(custom_id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')"
_CLASS = """case when not line_ok then 'invalid' when custom_id is null then 'no_id'
    when custom_id in (select custom_id from existing_results) then 'skipped' else 'new' end"""


def _extracted(t: Inputs) -> DataFrame:
    return jsonl.with_main_text(t.result_files)


@query(f"with {_DECODED} select doc_id, line_ok from decoded", "result_files")
def result_lines(t: Inputs) -> DataFrame:
    return jsonl.result_lines(t.result_files).select("doc_id", "line_ok")


@query(f"with {_DECODED} select doc_id, custom_id, content from decoded", "result_files")
def extract_main_text(t: Inputs) -> DataFrame:
    return _extracted(t).select("doc_id", "custom_id", "content")


@query(f"with {_DECODED} select doc_id, {_CLASS} as line_class from decoded", "result_files", "existing_results")
def classify_result_line(t: Inputs) -> DataFrame:
    return results.classify_lines(_extracted(t), t.existing_results).select("doc_id", "line_class")


_ANSWER_CLASS = f"""case when not line_ok then 'invalid_json' when custom_id is null then 'no_custom_id' when content is null then 'no_text'
    when not {_UUID} then 'bad_request_id' else 'good' end"""


@query(f"with {_DECODED} select batch_fk, {_ANSWER_CLASS} as answer_class, count(*) as n from decoded group by all", "result_files")
def split_good_bad(t: Inputs) -> DataFrame:
    good, bad = results.split_good_bad(cut_lineage(_extracted(t).select("batch_fk", "line_ok", "custom_id", "content"), "extracted"))
    return good.unionByName(bad).groupBy("batch_fk", "answer_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_DECODED} select batch_fk, count(*) as total, count(content) as ok, count(*) - count(content) as bad from decoded group by batch_fk", "result_files")
def extract_counts(t: Inputs) -> DataFrame:
    return results.extract_counts(_extracted(t), ["batch_fk"])


@query(f"""with {_DECODED}, c as (select batch_fk, {_CLASS} as line_class from decoded)
    select batch_fk, count(*) filter (where line_class = 'new') as downloaded, count(*) filter (where line_class = 'skipped') as skipped_existing
    from c group by batch_fk""", "result_files", "existing_results")
def fetch_counts(t: Inputs) -> DataFrame:
    return results.fetch_counts(results.classify_lines(_extracted(t), t.existing_results), ["batch_fk"])


@query(f"with {_DECODED} select doc_id, custom_id, {_UUID} as is_request_id from decoded where custom_id is not null", "result_files")
def custom_id_is_uuid(t: Inputs) -> DataFrame:
    return _extracted(t).where(F.col("custom_id").isNotNull()).select("doc_id", "custom_id", is_uuid("custom_id").alias("is_request_id"))


@query(f"""select conv_id, turn, trim(replace(text, '. ', {_NL}), {_WS} || '.') as content from conversations where trim(replace(text, '. ', {_NL}), {_WS} || '.') <> ''
    union all select doc_id, -1, trim({_NL} || text || chr(9), {_WS}) from documents where trim({_NL} || text || chr(9), {_WS}) <> ''""")
def nonblank_content(t: Inputs) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", F.trim(F.replace("text", F.lit(". "), F.lit("\n")), F.lit(WS_CHARS + ".")).alias("content"))
    docs = t.documents.select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), F.concat(F.lit("\n"), "text", F.lit("\t")).alias("content"))
    return results.nonblank_content(turns.unionByName(docs))


@query(f"with {_DECODED} select doc_id, custom_id from decoded where custom_id is not null and custom_id not in (select custom_id from existing_results)",
       "result_files", "existing_results")
def new_results_only(t: Inputs) -> DataFrame:
    return results.new_results_only(_extracted(t).where(F.col("custom_id").isNotNull()), t.existing_results).select("doc_id", "custom_id")


_MEMBER = """case when json_type(p, '$.results') = 'ARRAY' then 'results' when json_type(p, '$.data') = 'ARRAY' then 'data'
    when json_type(p, '$.items') = 'ARRAY' then 'items' end"""


@query(f"""with p0 as (select doc_id, payload::json as p from payloads), p1 as (select doc_id, p, {_MEMBER} as shape from p0),
    m as (select doc_id, shape, unnest((p -> ('$.' || shape))::json[]) as m from p1 where shape is not null)
    select doc_id, m ->> '$.custom_id' as request_id, case shape when 'results' then coalesce(m ->> '$.output_text', m ->> '$.content', '')
        when 'data' then coalesce(m ->> '$.output_text', m ->> '$.text', '') else coalesce(m ->> '$.response.output_text', m ->> '$.response.text', '') end as content,
      case when shape = 'results' then coalesce(m ->> '$.metadata.k', '-') else m ->> '$.custom_id' end as meta_key
    from m where length(m ->> '$.custom_id') = 36""", "payloads")
def extract_answers(t: Inputs) -> DataFrame:
    parsed = t.payloads.select("doc_id", once(F.try_parse_json("payload")).alias("p")).select("doc_id", once(variants.answers(F.col("p"))).alias("a"))
    rows = parsed.select("doc_id", F.inline("a"))
    meta = lambda p: F.get_json_object("metadata", p)
    return rows.select("doc_id", "request_id", "content", F.coalesce(meta("$.k"), meta("$.custom_id"), F.lit("-")).alias("meta_key"))


@query("""select event_id, json_valid(payload) and status <> 'expired' as ok, case when status not in ('expired', 'finalizing') then 'pb_' || batch_fk end as id,
      case when status not in ('expired', 'finalizing') then status end as status, case when status not in ('expired', 'finalizing') then error_file_id end as error_file_id,
      case when status not in ('expired', 'finalizing') then cast(event_id as varchar) end as total
    from status_payloads join provider_reports using (event_id)""", "status_payloads", "provider_reports")
def parse_batch_status(t: Inputs) -> DataFrame:
    s = t.status_payloads.select("event_id", once(variants.batch_status("payload")).alias("s"))
    return s.select(
        "event_id", F.col("s").isNotNull().alias("ok"), "s.id", "s.status", "s.error_file_id", F.get_json_object("s.request_counts", "$.total").alias("total"))


@query("""select uid, payload ->> '$.id' as id, payload ->> '$.status' as status, payload ->> '$.completed_at' as completed_at, payload ->> '$.request_counts.total' as total,
      payload ->> '$.request_counts.failed' as failed, payload ->> '$.usage.input_tokens_details.cached_tokens' as cached_tokens, payload ->> '$.usage.total_tokens' as total_tokens
    from submit_payloads where payload ->> '$.status' is not null""", "submit_payloads")
def parse_submit_response(t: Inputs) -> DataFrame:
    s = t.submit_payloads.select("uid", once(variants.submit_response("payload")).alias("s")).where(F.col("s").isNotNull())
    text = lambda p, n: F.col(p).cast("string").alias(n)
    return s.select(
        "uid", "s.id", "s.status", text("s.completed_at", "completed_at"), text("s.request_counts.total", "total"), text("s.request_counts.failed", "failed"),
        text("s.usage.input_tokens_details.cached_tokens", "cached_tokens"), text("s.usage.total_tokens", "total_tokens"))


@query("""select doc_id, payload ->> '$.id' as id, cast(payload ->> '$.bytes' as bigint) as bytes, payload ->> '$.filename' as filename
    from upload_payloads where payload ->> '$.purpose' is not null""", "upload_payloads")
def parse_upload_response(t: Inputs) -> DataFrame:
    s = t.upload_payloads.select("doc_id", once(variants.upload_response("payload")).alias("s")).where(F.col("s").isNotNull())
    return s.select("doc_id", "s.id", "s.bytes", "s.filename")


@query(f"""with {_DECODED} select doc_id, body ->> '$.usage.input_tokens' as input_tokens, body ->> '$.usage.output_tokens' as output_tokens,
    body ->> '$.usage.total_tokens' as total_tokens from decoded where line_ok""", "result_files")
def usage_columns(t: Inputs) -> DataFrame:
    body = once(variants.response_body(F.col("root"))).alias("body")
    u = jsonl.result_lines(t.result_files).where("line_ok").select("doc_id", body).select("doc_id", variants.usage(F.col("body")).alias("u"))
    return u.select("doc_id", *[F.col(f"u.{c}").cast("string").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


# ---- ordered texts ----------------------------------------------------------------------

_CHUNKS = f"""n as (select conv_id, text, row_number() over (partition by conv_id order by turn) as rn from conversations),
    c as (select conv_id, (rn - 1) // 3 as chunk_no, string_agg(text, {{sep}} order by rn) as s from n group by all),
    chunks as (select conv_id, cast(chunk_no as bigint) as chunk_no, case when chunk_no > 0 then {{sep}} else '' end || s as chunk from c)"""
_SEP = f"({_NL} || {_NL} || '---' || {_NL} || {_NL})"


@query(f"with {_CHUNKS.format(sep=_NL)} select * from chunks")
def ordered_concat(t: Inputs) -> DataFrame:
    return numbering.ordered_concat(t.conversations, ["conv_id"], ["turn"], "text", "\n", chunk_rows=3)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""with {_CHUNKS.format(sep=_SEP)}
    select conv_id, 0 as part_no, {_lit(results.PAGE_HEAD)} || split_part(chunk, {_NL}, 1) || {_lit(results.PAGE_STYLE)} as part from chunks where chunk_no = 0
    union all select conv_id, chunk_no + 1, chunk from chunks
    union all select conv_id, max(chunk_no) + 2, {_lit(results.PAGE_FOOT)} from chunks group by conv_id""")
def extracted_document(t: Inputs) -> DataFrame:
    return results.extracted_document(t.conversations, ["conv_id"], ["turn"], "text", chunk_rows=3)


# ---- references and pages ---------------------------------------------------------------

_REFS = f"""g as (select doc_id, {{}} from ref_texts),
    refs as (select doc_id, unnest(g0) as raw, unnest(g1) as kind, unnest(g2) as main, unnest(g3) as range_end, unnest(g4) as alt, unnest(generate_series(1, len(g0))) as pos from g)""".format(
    ", ".join(f"regexp_extract_all(text, '{refs.REF_PATTERN}', {i}) as g{i}" for i in range(5)))
_FOLDED = f"translate(kind, '{refs.HYPHENS}', '{'-' * len(refs.HYPHENS)}')"


@query(f"with {_REFS} select doc_id, pos, {_FOLDED} as kind, main, nullif(range_end, '') as range_end, nullif(alt, '') as alt, raw from refs", "ref_texts")
def deliverable_refs(t: Inputs) -> DataFrame:
    return pages.deliverable_refs(t.ref_texts, "doc_id")


@query(f"with {_REFS} select {_FOLDED} as kind, count(*) as n_refs, count(distinct doc_id) as n_docs from refs group by 1", "ref_texts")
def ref_summary(t: Inputs) -> DataFrame:
    return pages.ref_summary(t.ref_texts)


_RULES = " ".join(f"when '{k}' then '{v}'" for k, v in refs.TAG_CLASSES.items())


@query(f"""with g as (select page_id, regexp_extract_all(html, '{refs.OPEN_TAG_PATTERN}', 1) as a, regexp_extract_all(html, '{refs.OPEN_TAG_PATTERN}', 2) as b from ref_pages),
    u as (select page_id, lower(unnest(a)) as tag, unnest(b) as attrs from g),
    v as (select page_id, tag, case when regexp_matches(attrs, '(?i)\\sclass\\s*=\\s*"[^"]*"') then regexp_extract(attrs, '(?i)\\sclass\\s*=\\s*"([^"]*)"', 1) end as class,
      case tag {_RULES} end as rule from u),
    w as (select page_id, tag, class, rule, count(*) as n from v where rule is not null group by all)
    select page_id, tag, class, n, case when class = 'MY-6 nav' then 'MY-6 nav ' || replace(rule, ' my-6', '') when class is null then rule end as merged_class from w""", "ref_pages")
def add_tag_classes(t: Inputs) -> DataFrame:
    return pages.tag_inventory(t.ref_pages, "page_id")


@query(f"select page_id, regexp_replace(html, '(?i)(<head(?:\\s[^>]*)?>)', '\\1' || {_lit(refs.HEAD_ASSETS)}) as html from pages")
def insert_head_assets(t: Inputs) -> DataFrame:
    return t.pages.select("page_id", refs.insert_head_assets(F.col("html")).alias("html"))


@query("select doc_id, code_point, n from (" + " union all ".join(
    f"select doc_id, 'U+{cp:04X}' as code_point, length(text) - length(replace(text, chr({cp}), '')) as n from digit_texts"
    for cp in refs.UNCOVERED_CODE_POINTS) + ") x where n > 0", "digit_texts")
def uncovered_characters(t: Inputs) -> DataFrame:
    return pages.uncovered_characters(t.digit_texts, "doc_id")


@query("""with g as (select doc_id, regexp_extract_all(text, '\\$([^$\\n]+)\\$', 1) as s from math_texts),
    u as (select doc_id, unnest(s) as span, unnest(generate_series(1, len(s))) as pos from g)
    select doc_id, pos, span, starts_with(span, '^') or contains(span, '\\d{') or contains(span, '\\(') or contains(span, '\\)') or contains(span, 'GF-NOTE-')
      or contains(span, 'DMCC-GF-') as is_regex from u""", "math_texts")
def looks_regex_like(t: Inputs) -> DataFrame:
    return pages.math_spans(t.math_texts, "doc_id")


@query()
def annotate_refs(t: Inputs) -> DataFrame:
    return pages.annotate_refs(t.ref_pages)


@query()
def annotated_pages(t: Inputs) -> DataFrame:
    path = shared_dir(t.spark, "annotated-pages")
    pages.annotated_pages(t.ref_pages).write.parquet(path)
    return t.spark.read.parquet(path)


# ---- objects ----------------------------------------------------------------------------

@query(f"""select {uuid_sql('name').replace('md5(name)', 'sha256(text)[1:32]')} as locator, 'source' as kind, min(octet_length(encode(text))) as bytes, sha256(text) as digest
    from stored group by text""", "stored")
def object_index_register(t: Inputs) -> DataFrame:
    rows = objects.index_rows(t.stored, "text", "source", "text/plain", AS_OF)
    target = t.spark.createDataFrame([], rows.schema)
    registered = production.register_objects(target, rows)
    return registered.select("locator", "kind", "bytes", F.lower(F.hex("sha256")).alias("digest"))


@query("select prefix, page_id, bytes from object_keys join key_prefixes on starts_with(key, prefix)", "object_keys", "key_prefixes")
def list_objects_by_prefix(t: Inputs) -> DataFrame:
    return objects.list_by_prefix(t.object_keys, t.key_prefixes).select("prefix", "page_id", "bytes")


@query("select doc_id, name, text from stored where doc_id in (select doc_id from labels)", "stored")
def read_object(t: Inputs) -> DataFrame:
    return objects.read_objects(t.stored, t.labels, "doc_id").select("doc_id", "name", "text")


@query(f"select doc_id, octet_length(encode(text)) as size, sha256(text) as digest from encoded join stored using (doc_id)", "encoded", "stored")
def decode_b64_assets(t: Inputs) -> DataFrame:
    return objects.decode_base64(t.encoded, "content64").select("doc_id", "size", F.sha2("content", 256).alias("digest"))


@query("select eid, version, size from (select *, row_number() over (partition by eid order by version desc) as rn from asset_versions) x where rn = 1", "asset_versions")
def latest_asset_version(t: Inputs) -> DataFrame:
    return objects.latest_version(t.asset_versions)


@query("select distinct regexp_extract(path, '([^/]*)\\.json$', 1) as custom_id from result_paths where path like '%.json'", "result_paths")
def existing_ids(t: Inputs) -> DataFrame:
    return objects.existing_ids(t.result_paths)


# ---- sinks, written and read back -------------------------------------------------------

@query(f"""with {_DECODED}, c as (select batch_fk, {_CLASS} as line_class from decoded)
    select batch_fk, 'completed' as status, count(*) filter (where line_class = 'new') as downloaded, count(*) filter (where line_class = 'skipped') as skipped_existing,
      cast(count(*) as varchar) as total from c group by batch_fk""", "result_files", "existing_results")
def fetch_summary(t: Inputs) -> DataFrame:
    statuses = t.result_files.groupBy("batch_fk").agg(F.count(F.lit(1)).alias("total")).select(
        "batch_fk", F.lit("completed").alias("status"), F.to_json(F.struct("total")).alias("request_counts"))
    summary = results.fetch_summary(results.classify_lines(_extracted(t), t.existing_results), statuses, ["batch_fk"])
    path = shared_dir(t.spark, "fetch-summary")
    jsonl.write_summary(summary, path)
    back = t.spark.read.schema(summary.schema).json(path)
    return back.select("batch_fk", "status", "downloaded", "skipped_existing", F.get_json_object("request_counts", "$.total").alias("total"))


@query(f"with {_DECODED} select custom_id, line from decoded where {_CLASS} = 'new'", "result_files", "existing_results")
def materialise_new_results(t: Inputs) -> DataFrame:
    new = results.classify_lines(_extracted(t), t.existing_results).where(F.col("line_class") == "new")
    path = shared_dir(t.spark, "results")
    jsonl.materialise_results(results.last_per_id(new.select("custom_id", "doc_id", "line"), "doc_id"), path, buckets=8)
    return t.spark.read.parquet(path).select("custom_id", "line")


@query(f"""select {uuid_sql("cast(doc_id as varchar)")} as custom_id, text as user_text, cast((rn - 1) // 200 as bigint) as block
    from (select doc_id, text, row_number() over (order by doc_id) as rn from documents) x""")
def request_jsonl(t: Inputs) -> DataFrame:
    rows = t.documents.select(stable_uuid("doc_id").alias("request_id"), F.col("text").alias("request_text"), "doc_id")
    lines = production.submission_lines(rows, ["doc_id"], system_text="s", model="gpt-5")
    path = shared_dir(t.spark, "request-jsonl")
    jsonl.write_request_jsonl(lines, path, batches_per_folder=20)
    back = t.spark.read.text(path)
    return back.select(
        F.get_json_object("value", "$.custom_id").alias("custom_id"), F.get_json_object("value", "$.body.input[1].content[0].text").alias("user_text"),
        F.col("block").cast("bigint").alias("block"))


@query(f"""with h as materialized (select doc_id, {_FNV.format('text')} as fnv from documents)
    select 'doc-fnv1a64-' || fnv as prompt_cache_key, fnv as document_hash_fnv64, 'file-' || cast(doc_id as varchar) as batch_input_file_id,
    'batch-' || cast(doc_id as varchar) as batch_id, '/v1/responses' as endpoint, '24h' as completion_window, 'gpt-5' as model_used from h""")
def run_manifest(t: Inputs) -> DataFrame:
    rows = production.manifests(
        t.documents.withColumn("k", F.col("doc_id").cast("string")), "text", F.concat(F.lit("file-"), "k"), F.concat(F.lit("batch-"), "k"), "gpt-5")
    path = shared_dir(t.spark, "manifest")
    jsonl.write_manifest(rows, path)
    return jsonl.read_manifest(t.spark, path)
