"""Shapes of the plans: pruned scans, pushed filters, no needless shuffles."""

import os
import re

import pytest
from pyspark.sql import functions as F

from boardlake.operators import curation, images, inspections
from boardlake.plans import load
from boardlake.plans.catalog import QUERIES
from boardlake.plans.views import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not mounted")
load()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name: str) -> str:
    return plan_of(QUERIES[name].run(spark, FOLDER))


def test_metrics_read_two_columns_in_one_pass(spark):
    text = plan(spark, "d01_kpi_totals")
    assert text.count("FileScan") == 1
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>", text)


def test_latest_row_needs_no_window(spark):
    text = plan(spark, "e01_latest_per_key")
    assert "Window" not in text and text.count("Exchange hashpartitioning") == 1


def test_top_rows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "f09_head_sample")


def test_newest_rows_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "f03_newest_runs")


def test_filters_reach_the_scan(spark):
    stored = Tables(spark, FOLDER).lineitem.select(F.col("l_returnflag").alias("result"), "l_orderkey")
    text = plan_of(inspections.filter_inspections(stored, result="R"))
    assert "EqualTo(l_returnflag,R)" in text


def test_point_operators_do_not_shuffle(spark):
    assert "Exchange" not in plan_of(images.threshold(images.to_bytes(Tables(spark, FOLDER).v_scanline), 130))


def test_a_stencil_shuffles_once(spark):
    text = plan_of(images.gaussian_blur(Tables(spark, FOLDER).v_scanline, 5, 1.0))
    assert text.count("Exchange hashpartitioning") == 1


def test_document_differences_do_not_shuffle(spark):
    assert "Exchange" not in plan(spark, "c08_document_diff")


def test_approximate_profile_keeps_types(spark):
    customer = Tables(spark, FOLDER).customer.select(F.col("c_custkey").cast("string").alias("k"), "c_mktsegment")
    exact = {r["column_name"]: r for r in curation.column_profile(customer, customer.columns).collect()}
    rough = {r["column_name"]: r for r in curation.column_profile(customer, customer.columns, approximate=True).collect()}
    for name, row in exact.items():
        assert rough[name]["data_type"] == row["data_type"] and rough[name]["missing_count"] == row["missing_count"]
        assert abs(rough[name]["unique_count"] - row["unique_count"]) <= 0.1 * row["unique_count"] + 1
