"""Literal cases for the Column builders."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmill.functions import details, hashing, refs, requests, template, text, variants
from promptmill.plans import production


def fnv(data: bytes) -> str:
    h = 14695981039346656037
    for b in data:
        h = ((h ^ b) * 1099511628211) % 2**64
    return f"{h:016x}"


HEADER_VALUES = [
    ('"ab"', "string", '"ab"'), ('"a\\\\nb"', "string", '"a\\nb"'), ("true", "boolean", "true"), ("2.0", "number", "2"), ("1.5", "number", "1.5"),
    ("007", "number", "7"), ("-3", "number", "-3"), ("+5", "string", '"+5"'), ("5.", "string", '"5."'), (".5", "string", '".5"'), ("1-2", "string", '"1-2"'),
    ("2026-01-24", "string", '"2026-01-24"'), ("5 # c", "string", '"5 # c"'), ("[]", "array", '[""]'), ('["a,b"]', "array", '["\\"a","b\\""]'),
    ("[1, x , true]", "array", '[1,"x",true]'), ("[[1], [ 2 ]]", "array", "[[1],[2]]"), ("[[]]", "array", '[[""]]'), ("[[1,2]]", "array", '["[1","2]"]'),
    ("[[]", "array", '["["]'), ("[ [ [a] ], b]", "array", '[[["a"]],"b"]'), ("[ [x [y]] ]", "array", '[["x [y]"]]'),
    ("[" * 9000 + "7" + "]" * 9000, None, None), ("[" + ", ".join(["[ 1 ]"] * 3000) + "]", "array", json.dumps([[1]] * 3000)), ("[", "string", '"["'), ('"', "string", '"\\""'), ("", "string", '""'),
]


def test_header_value(each):
    got = each([v for v, _, _ in HEADER_VALUES], text.header_value)
    for (value, vtype, js), g in zip(HEADER_VALUES, got):
        if js is None:  # nested too deeply for the JSON reader here
            assert g["vtype"] == "array" and g["json"] == value
        else:
            assert (g["vtype"], json.loads(g["json"])) == (vtype, json.loads(js)), value[:50]


def test_header_value_can_respect_quotes(one):
    assert one('["a,b", c]', lambda c: text.header_value(c, respect_quotes=True))["json"] == '["a,b","c"]'


def test_unescape_order(one):
    assert one("a\\\\nb", text.unescape) == "a\nb"  # two backslashes and an n: the pair folds first
    assert one('\\"\\t', text.unescape) == '"\t'


def test_strip_and_pad(one):
    assert one("  \t　x y\n", text.strip_ws) == "x y"
    assert one(" \n", text.nonblank) is None
    assert [one(v, text.pad4) for v in ("7", "12345")] == ["0007", "12345"]
    assert one("x", lambda c: text.rewrite_prompt(F.lit(3), c)) == 'Generate a first version for item 3, "x"'
    assert one("2026-01-02 03:04:05", lambda c: text.format_moment(c.cast("timestamp_ntz"))) == "260102_030405"
    assert one('a"\n', text.json_string) == '"a\\"\\n"'


def test_lease_boundary(one):
    now = "2026-01-01 00:00:00"
    free = lambda t: one(t, lambda c: text.lease_free(c.cast("timestamp_ntz"), now))
    assert free("2025-12-31 23:59:59") and not free(now) and not free("2026-01-01 00:00:01") and free(None)
    assert str(one("x", lambda c: text.lease_until(now, 60))) == "2026-01-01 00:01:00"


def test_fnv(spark, one):
    for t, want in {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "héllo": "a35ff71f960240e0"}.items():
        assert one(t, hashing.fnv1a64_hex) == one(t, hashing.fnv1a64_hex_expr) == want == fnv(t.encode())
    rows = [(("x" * (i * 37 % 400) + "é") * (i % 3),) for i in range(200)] + [("long " * 5000,), (None,)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    got = df.select("t", hashing.fnv1a64_hex("t").alias("h")).collect()
    assert all(r["h"] == (None if r["t"] is None else fnv(r["t"].encode())) for r in got)
    assert one("a", lambda c: hashing.cache_key(c)) == "doc-fnv1a64-af63dc4c8601ec8c"
    assert one("a", lambda c: hashing.cache_key(c, F.lit("mine"))) == "mine"


def test_requests_are_hashed_in_batches_of_bounded_bytes(spark):
    session = spark.newSession()
    rows = session.range(60, numPartitions=1).select(F.col("id").cast("string").alias("request_id"), F.repeat(F.lit("a"), 1_000_000).alias("request_text"), "id")
    lines = production.submission_lines(rows, ["id"], "s", "m")
    sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"n": [len(b)]}) for b in batches), "n bigint").collect()
    assert sum(r.n for r in sizes) == 60 and max(r.n for r in sizes) < 30
    want = "doc-fnv1a64-" + fnv(("\n" + "\n".join(["a" * 1_000_000] * 2)).encode())
    short = production.submission_lines(rows.where("id < 2"), ["id"], "s", "m")
    assert [r.cache_key for r in short.collect()] == [want] * 2 and lines.count() == 60


RESULT_LINES = [
    ('{"response":{"body":{"output_text":"t","output":[{"type":"message","content":[{"text":"u"}]}]}}}', "t\n\nu"),
    ('{"response":{"body":{"output_text":["a",3,null," b "]}}}', "a\n\nb"),
    ('{"response":{"x":1},"output_text":"no"}', None),
    ('{"response":{"body":null},"output_text":"no"}', None),
    ('{"response":null,"output_text":"yes"}', "yes"),
    ('{"response":"text","output_text":"yes"}', "yes"),
    ('{"output":[{"type":"reasoning","content":[{"text":"no"}]},7,{"type":"message","content":[{"type":"other","text":"a"},{"text":5},"x",{"text":"b"}]}]}', "a\n\nb"),
    ('{"output_text":7,"output":"x"}', None), ('{"output_text":"  "}', None), ("[1]", None), ("nonsense", None), ('"s"', None),
]


def test_main_text(each):
    got = each([line for line, _ in RESULT_LINES], lambda c: variants.body_text(variants.response_body(F.try_parse_json(c))))
    for (line, want), g in zip(RESULT_LINES, got):
        assert g == want, line


@pytest.mark.parametrize("payload,want", [
    ('{"results":[{"custom_id":"%s","output_text":"a","content":"b"},{"custom_id":"no"}],"data":[]}', [("{}", "a")]),
    ('{"results":{},"data":[{"custom_id":"%s","text":"t"}]}', [(None, "t")]),
    ('{"items":[{"custom_id":"%s","response":{"text":"t"}},{"custom_id":"%s"}]}', [(None, "t"), (None, "")]),
    ('{"results":[{"custom_id":"%s","metadata":{"k":1}}]}', [('{"k":1}', "")]), ("{}", None),
])
def test_answers(one, payload, want):
    uid = "00000000-0000-4000-8000-00000000000A"
    got = one(payload.replace("%s", uid), lambda c: variants.answers(F.try_parse_json(c)))
    if want is None:
        assert got is None
        return
    assert [(r["request_id"], r["content"]) for r in got] == [(uid.lower(), c) for _, c in want]
    assert all(m is None or r["metadata"] == m for r, (m, _) in zip(got, want))


def test_provider_payloads(one, each):
    whole, partial, broken = each(['{"id":"b","status":"x","output_file_id":null}', '{"id":"b"}', "nonsense"], variants.batch_status)
    assert whole["status"] == "x" and partial is None and broken is None
    upload = '{"id":"f","object":"file","bytes":1,"created_at":2,"expires_at":3,"filename":"n"%s}'
    assert one(upload % ',"purpose":"batch"', variants.upload_response)["bytes"] == 1
    assert one(upload % "", variants.upload_response) is None
    mapped = each(["failed", "expired", "validating", None], lambda c: variants.provider_status(c, F.lit(None).cast("string")))
    assert [tuple(m) for m in mapped] == [("failed", "", False), ("error", None, True), ("validating", None, False), ("error", None, True)]
    named = ["completed", "cancelled", "failed", "finalizing", "in_progress", "validating", "running", "error"]
    assert each(named, variants.provider_status_text) == named


def test_request_line(one):
    build = lambda effort: json.loads(one("hi", lambda c: requests.request_line(F.lit("id"), F.lit("sys"), c, F.lit("k"), F.lit("m"), effort)))
    line = build(F.lit("high"))
    assert line["custom_id"] == "id" and line["method"] == "POST" and line["url"] == "/v1/responses"
    assert line["body"]["max_output_tokens"] == 200000 and line["body"]["reasoning"] == {"effort": "high"}
    assert line["body"]["input"] == [
        {"role": "system", "content": [{"type": "input_text", "text": "sys"}]}, {"role": "user", "content": [{"type": "input_text", "text": "hi"}]}]
    assert "reasoning" not in build(None)["body"] and "reasoning" not in build(F.lit(None).cast("string"))["body"]
    assert one("x", lambda c: requests.numbered_id(F.lit("m"), F.lit(3))) == "q_m_0003"


def test_details_nulls(one):
    null = F.lit(None).cast("string")
    assert json.loads(one("x", lambda c: details.polled(c, null))) == {"event": "polled", "provider_status": "x", "reason": None}
    assert json.loads(one("x", lambda c: details.provider_terminal(c, null))) == {"event": "provider_terminal", "terminal_kind": "x"}
    assert json.loads(one("x", lambda c: details.answer_materialized(c, F.lit("null")))) == {"event": "answer_materialized", "batch_uid": "x", "metadata": None}


REF_TEXT = "DOC‑05 sch, SEC–MKT-12..14/02, XTAX-0199 GOV-1 SEC-MKT-x SEC-03../7"


def test_references(spark):
    df = spark.createDataFrame([(1, REF_TEXT)], "k int, text string")
    from promptmill.operators import pages

    rows = pages.deliverable_refs(df, "k").orderBy("pos").collect()
    assert [(r.kind, r.main, r.range_end, r.alt, r.raw) for r in rows] == [
        ("DOC", "05", None, None, "DOC‑05"), ("SEC-MKT", "12", "14", "02", "SEC–MKT-12..14/02"), ("TAX", "01", None, None, "TAX-01"),
        ("SEC", "03", None, None, "SEC-03")]


def test_hyphens_keep_length(one):
    assert one("a‐b—c", refs.fold_hyphens) == "a-b-c"


@pytest.mark.parametrize("old,new,want", [("A my-1 a", "MY-1 b", "A my-1 b"), (None, "x y", "x y"), ("", "x X", "x"), ("  k ", "k", "k")])
def test_merge_class(one, old, new, want):
    assert one(old, lambda c: refs.merge_class(c, F.lit(new))) == want
    assert one("a DLV-Ref", lambda c: refs.has_class(c, "dlv-ref")) and not one("dlv-refs", lambda c: refs.has_class(c, "dlv-ref"))


def test_head_assets(one):
    add = lambda h: one(h, lambda c: refs.insert_head_assets(c, "<x>"))
    assert add('<HEAD a="1"><head>') == '<HEAD a="1"><x><head>'
    assert add("<header></header>") == "<header></header>"


def test_template(one):
    ctx = template.item_context(F.lit("P"), F.lit(2), F.lit("body"), F.lit('{"a":{"b":"v"},"l":[1,"z"],"zero":0,"empty":"","no":null,"f":"false"}'), F.lit("h"))
    show = lambda t: one("x", lambda c: template.to_column(t, ctx))
    assert show("{{ production.name }}/{{index}}/{{ meta.a.b }}/{{ nope }}/{{ item.meta.l }}/{{ text }}{{header_toml}}") == 'P/2/v//[1,"z"]/bodyh'
    assert show("{% for x in meta.l %}<{{ x }}{% if x %}!{% endif %}>{% endfor %}.") == "<1!><z!>."
    for name, want in (("zero", "n"), ("empty", "n"), ("no", "n"), ("missing", "n"), ("f", "y"), ("a", "y")):
        assert show("{% if meta." + name + " %}y{% else %}n{% endif %}") == want
    for bad in ("{% include x %}", "{% if meta.a %}", "{% endif %}", "{% for x %}{% endfor %}"):
        with pytest.raises(ValueError):
            show(bad)


def test_template_conditions(one):
    meta = '{"n":3,"s":"x","l":[{"n":1,"o":{"p":"a"}},{"n":2}],"e":""}'
    ctx = template.item_context(F.lit("P"), F.lit(1), F.lit("body"), F.lit(meta), F.lit("h"))
    show = lambda t: one("x", lambda c: template.to_column(t, ctx))
    assert show("{% if index == 1 %}Y{% else %}N{% endif %}") == "Y"
    assert show("{% if index != 1 %}Y{% elif meta.n == 3.0 %}E{% else %}N{% endif %}") == "E"
    assert show("{% if not meta.zz %}Y{% else %}N{% endif %}") == "Y"
    assert show("{% if meta.s == 'x' and not (meta.e or meta.zz) %}Y{% endif %}") == "Y"
    assert show("{% if meta.s == 'y' or meta.s == \"x\" %}Y{% endif %}|{% if true %}t{% endif %}") == "Y|t"
    assert show("{% for x in meta.l %}{{ x.n }}{{ x.o.p }};{% endfor %}") == "1a;2;"
    assert show("{% for x in meta.l %}{% if x.n == 2 %}two{% else %}{{ index }}{% endif %}{% endfor %}") == "1two"


@pytest.mark.parametrize("text", [
    "{{ text|upper }}", "{# c #}", "{%- if text -%}x{% endif %}", "{{ meta['id'] }}", "{% if text > 1 %}x{% endif %}", "{% if %}x{% endif %}", "{{ text",
    "{% set a = 1 %}", "{% if text and %}x{% endif %}", "{% if (text %}x{% endif %}", "{% else x %}", "{% for x of meta.l %}{% endfor %}"])
def test_templates_out_of_the_grammar_are_errors(text, spark):
    ctx = template.item_context(F.lit("P"), F.lit(1), F.lit("body"), F.lit("{}"), F.lit("h"))
    with pytest.raises(ValueError):
        template.to_column(text, ctx)


def test_whole_numbers_keep_the_digits_of_their_double(one):
    assert one("1234567890123456789", lambda c: text._number_json(c)) == "1234567890123456768"
    assert one("12.50", lambda c: text._number_json(c)) == "12.5"


def test_uuid_takes_no_line_end(one):
    uid = "00000000-0000-4000-8000-000000000001"
    assert one(uid, text.is_uuid) is True and one(uid + "\n", text.is_uuid) is False


def test_python_workers_get_the_package(spark, monkeypatch):
    """Whoever calls a function with Python workers need not ship the package."""
    from promptmill import session
    from promptmill.operators import pages
    from promptmill.sources import corpus

    df = spark.createDataFrame([("a = 1\n", "<p></p>")], "header_toml string, html string")
    for use in (lambda: hashing.cache_key(F.col("html")), lambda: pages.annotate_refs(df), lambda: corpus.with_item_meta(df)):
        sent = []
        monkeypatch.setattr(session, "_shipped", set())
        monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
        use()
        assert len(sent) == 1 and sent[0].endswith(".zip")
        monkeypatch.undo()
