"""Every registered query runs, equals its SQL twin, and has the plan it should have."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect
from promptmill.plans.inputs import Inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name in oracle_sql():
        ok, note = compare(df, con, oracle_sql()[name])
        assert ok, note
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["batch_no", "request_count", "prompt_chars"] and df.count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_poll_plan(spark):
    p = plan(queries()["pollable_batches"](spark, SF))
    assert "LeftSemi" in p and "LeftAnti" in p and "TakeOrderedAndProject" in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(Inputs(spark, SF).requests.where("state = 'entered'").select("request_id"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    assert set(re.findall(r"(\w+):", schema)) == {"o_orderkey", "o_orderstatus"}
    p = plan(Inputs(spark, SF).answers.select("request_fk"))
    assert "EqualTo(l_linestatus,F)" in p


@pytest.mark.parametrize("name", ["deliverable_refs", "extract_main_text", "source_items", "render_template"])
def test_no_shuffle_but_the_spreading_of_a_single_split(spark, name):
    p = plan(queries()[name](spark, SF))
    assert not re.search(r"Exchange (?!RoundRobin)", p)


def test_costly_text_work_happens_once(spark):
    p = plan(queries()["deliverable_refs"](spark, SF))
    assert len(re.findall(r"regexp_extract_all\(", p.split("Exchange")[0])) == 1
    p = plan(queries()["extract_main_text"](spark, SF))
    assert len(re.findall(r"parseJson\(", p)) == 1


def test_no_cross_joins(spark):
    for name in ("list_objects_by_prefix", "fk_audit", "classify_result_line", "answers_materialized", "response_kind"):
        p = plan(queries()[name](spark, SF))
        assert "CartesianProduct" not in p and "NestedLoop" not in p, name
