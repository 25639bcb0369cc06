"""Corpora, prompts and productions."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from promptmill.plans import production
from promptmill.schemas import TABLES
from promptmill.sources import corpus, jsonl
from promptmill.sources import lines as lines_
from promptmill.sources.tables import conform

D = corpus.DELIMITER


def items(spark, *texts):
    out = corpus.source_items(spark.createDataFrame(list(enumerate(texts)), "k int, corpus string"))
    return out.items.orderBy("k", "item_index").collect(), {r.k: r.reason for r in out.rejects.collect()}


def test_split_cases(spark):
    got, bad = items(
        spark, f"pre\n{D}\na = 1\n{D}\nbody", f"{D}\n{D}\n{D}\n  {D}\t\n", f"{D}\nopen = 1\n", "no items at all", f"{D}\nbad line\n{D}\n",
        f"x {D}\n{D}\r\nk=v\n{D}\nb\n\n")
    assert [(r.k, r.item_index, r.header_toml, r.body) for r in got] == [
        (0, 1, "a = 1\n", "body\n"), (1, 1, "", ""), (1, 2, "", ""), (5, 1, "k=v\n", "b\n\n")]
    assert bad == {2: corpus.UNCLOSED, 4: corpus.BAD_HEADER}


def test_meta_rules(spark):
    header = '# c\na = 1\na.b = 2\n\nx.y = "q"\nx.y.z = [1]\nk = 1\nk = 2\ns = 5 # c\nv = a=b\n'
    df = spark.createDataFrame([(1, header, "b")], "k int, header_toml string, body string")
    row = corpus.with_item_meta(df).first()
    assert json.loads(row.item_meta) == {"a": {"b": 2}, "x": {"y": {"z": [1]}}, "k": 2, "s": "5 # c", "v": "a=b"}
    deep = "[" * 5000 + "]" * 5000
    other = spark.createDataFrame([(1, f"d.e = {deep}\n", "b"), (2, "", "b"), (3, "# c\n", "b")], "k int, header_toml string, body string")
    assert {r.k: r.item_meta for r in corpus.with_item_meta(other).collect()} == {
        1: '{"d":{"e":' + "[" * 5000 + '""' + "]" * 5000 + "}}", 2: "{}", 3: "{}"}
    entries = corpus.front_matter_entries(df).orderBy("line_no").collect()
    assert [(r.line_no, r.key) for r in entries] == [(2, "a"), (3, "a.b"), (5, "x.y"), (6, "x.y.z"), (7, "k"), (8, "k"), (9, "s"), (10, "v")]


def test_prompts(spark):
    text = "  \n3: A: B\r\n\r\nx: A\n\n3:\n\n 12 : two\nlines \n \n+4: no\n\n5 x: no"
    gap = "\n" + " \n\t\n" * 30000  # a very long run of blank lines
    df = spark.createDataFrame([(1, text), (2, "nothing")], "k int, prompts string")
    far = spark.createDataFrame([(3, "1: a" + gap + "2: b" + gap)], "k int, prompts string")
    assert [(r.number, r.title) for r in corpus.prompt_blocks(far).orderBy("block_no").collect()] == [(1, "a"), (2, "b")]
    got = corpus.prompt_blocks(df).orderBy("block_no").collect()
    assert [(r.number, r.title) for r in got] == [(3, "A: B"), (12, "two\nlines")]
    assert got[0].prompt == 'Generate a first version for item 3, "A: B"'
    assert [r.k for r in corpus.files_without_prompts(df, "k").collect()] == [2]


line = st.text(st.characters(blacklist_characters="\n\r", blacklist_categories=("Cs", "Cc")), max_size=12).filter(lambda s: s.strip() != D)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.tuples(st.sampled_from("abc"), line), max_size=3), st.lists(line, max_size=4)), max_size=4))
def test_written_items_come_back(spark, parts):
    text = "".join(D + "\n" + "".join(f"{k} = {v}\n" for k, v in h) + D + "\n" + "".join(b + "\n" for b in body) for h, body in parts)
    got, bad = items(spark, text)
    assert not bad
    assert [(r.header_toml, r.body) for r in got] == [
        ("".join(f"{k} = {v}\n" for k, v in h), "".join(b + "\n" for b in body)) for h, body in parts]


def test_new_productions(spark):
    text = f'{D}\nn = "x"\n{D}\nbody\n{D}\n{D}\nsecond'
    df = spark.createDataFrame([("p1", "s1", text), ("p2", "s2", D)], "production_name string, source_name string, corpus string")
    new = production.new_productions(df, "tpl", "{{ index }}:{{ meta.n }}:{{ text }}", "2026-01-01 00:00:00")
    assert [r.request_text for r in new.requests.orderBy("item_index").collect()] == ["1:x:body\n", "2::second\n"]
    assert [r.production_name for r in new.productions.collect()] == ["p1"] and [r.production_name for r in new.rejects.collect()] == ["p2"]
    assert {r.kind for r in new.s3_objects.collect()} == {"template", "source"} and new.request_events.count() == 2
    ids = {r.locator for r in new.s3_objects.collect()}
    assert {r.s3_locator for r in new.asset_sources.collect()} | {r.s3_locator for r in new.asset_templates.collect()} == ids
    assert new.productions.join(new.asset_sources, "source_id").count() == new.productions.join(new.asset_templates, "template_id").count() == 1
    with pytest.raises(production.RepeatedProduction):
        production.new_productions(df, "tpl", "t", "2026-01-01 00:00:00", existing=new.productions)


def test_read_corpus_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"{D}\nk = 1\n{D}\nbody")
    got = corpus.source_items(corpus.read_corpus(spark, str(tmp_path))).items.collect()
    assert len(got) == 1 and got[0].source_name.endswith("a.txt")


def test_saved_production(spark, tmp_path):
    df = spark.createDataFrame([("p1", "s1", f"{D}\nn = 1\n{D}\nbody")], "production_name string, source_name string, corpus string")
    new = production.new_productions(df, "tpl", "{{ text }}", "2026-01-01 00:00:00")
    new.requests.write.parquet(f"{tmp_path}/p/requests")  # as an unfinished run leaves it
    production.save_production(new, f"{tmp_path}/p")
    saved = {n: spark.read.parquet(f"{tmp_path}/p/{n}") for n in new._fields}
    for name in ("requests", "request_events", "s3_objects", "productions", "asset_sources", "asset_templates"):
        table = conform(saved[name], TABLES[name])
        assert table.schema.names == TABLES[name].names and table.count() == saved[name].count()
    assert {n: d.count() for n, d in saved.items()} == {n: {"s3_objects": 2, "rejects": 0}.get(n, 1) for n in new._fields}
    with pytest.raises(production.RepeatedProduction):
        production.save_production(new, f"{tmp_path}/p")


def test_large_files_in_splits(spark, tmp_path):
    """Read line by line in many splits, a file gives what it gives when it is split as a whole."""
    many = "preamble\n" + "".join(f"  {D}\t\nn = {i}\nx = \"é\"\n{D}\nbody {i}\n\n -*-*- \nend" + "\r\n" * (i % 3) + "\n" for i in range(120))
    files = {"many": many, "unclosed": f"{D}\na = 1\n", "bad": f"{D}\na = 1\n{D}\nb\n{D}\nno value\n{D}\n", "none": "nothing\n", "empty": f"{D}\n{D}\n{D}\n{D}", "open": f"{D}\na = 1\n{D}\nb\n{D}\nc = 1"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        large = corpus.large_corpus_items(spark, str(tmp_path))
        got = sorted((r.source_name.rsplit("/", 1)[1], r.item_index, r.header_toml, r.body) for r in large.items.collect())
        bad = {(r.source_name.rsplit("/", 1)[1], r.reason) for r in large.rejects.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = corpus.source_items(corpus.read_corpus(spark, str(tmp_path)))
    assert got == sorted((r.source_name.rsplit("/", 1)[1], r.item_index, r.header_toml, r.body) for r in whole.items.collect())
    assert bad == {(r.source_name.rsplit("/", 1)[1], r.reason) for r in whole.rejects.collect()} == {("unclosed", corpus.UNCLOSED), ("open", corpus.UNCLOSED), ("bad", corpus.BAD_HEADER)}
    assert len(got) == 122


def test_a_name_given_twice_fails(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y")], "production_name string, source_name string, corpus string")
    with pytest.raises(production.RepeatedProduction):
        production.new_productions(df, "tpl", "{{ text }}", "2026-01-01 00:00:00")


def test_lines_are_numbered_over_tiny_splits(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for n in range(4):
        lines = [rng.choice(["", "a", "ü" * rng.randrange(40), "x\r", '{"custom_id":"1"}']) for _ in range(rng.choice([0, 1, 100]) if n else 200)]
        (tmp_path / f"b{n}.jsonl").write_bytes("\n".join(lines).encode() + b"\n" * (n % 2))
        want += [(f"b{n}", i, t) for i, t in enumerate(lines, 1) if t]
    for size in ("301", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = jsonl.read_result_files(spark, str(tmp_path))
            assert sorted((r.batch_fk, r.line_no, r.line) for r in df.collect()) == sorted(want), size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    splits = lines_.read_splits(spark, str(tmp_path))
    plan = splits._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "wholetext" not in plan
    assert splits.where("path like '%b0.jsonl'").count() in (200, 201)
