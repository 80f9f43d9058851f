"""Searches of texts stand once in a plan, whatever is asked of their results."""

import pytest

from palisade.queries import QUERIES

SF = "/root/testdata/sf0.001"


def searches(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


@pytest.fixture(scope="module")
def once(spark):
    """The searches of a query that asks for every row."""
    old = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    yield searches(QUERIES["decision_by_doc"](spark, SF))
    spark.conf.set("spark.sql.maxPlanStringLength", old)


def test_refusals_search_once(spark, once):
    assert 0 < searches(QUERIES["refusal_documents"](spark, SF)) == once


def test_logged_findings_search_once(spark, once):
    assert 0 < searches(QUERIES["redaction_log"](spark, SF)) == once


def test_restored_placeholders_search_once(spark, once):
    # one for the placeholders that a text asks for, one for their places
    assert searches(QUERIES["restore_log"](spark, SF)) == 2
