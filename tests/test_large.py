"""What tasks hold and what the driver is sent, for queries over tables that are larger than their files look."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from veldspar import catalog
from veldspar.contracts import ContractError
from veldspar.operators import shortlist
from veldspar.plans import panel, peers
from veldspar.store import cut


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dashboard_rule_detail", "sample_drilldown"])
def test_indicators_are_not_broadcast(spark, sf, name):
    joins = [line for line in _plan(catalog.QUERIES[name](spark, sf)).splitlines() if "Join" in line and "source_reporting_period" in line]
    assert joins and all("SortMergeJoin" in j or "LeftSemi, BuildRight" in j for j in joins)


def _rows(spark, products=3, n=3000):
    return spark.range(n).select((F.col("id") % products).cast("string").alias("product"), F.when(F.col("id") % 11 > 0, F.col("id") % 97 / 7).alias("a"), (F.col("id") % 5 * -1.5).alias("b"), "id")


@pytest.mark.parametrize("most", [peers.SHARES, 0])
def test_ranks_by_value_equal_windowed_ranks(spark, monkeypatch, most):
    df = _rows(spark)
    key = lambda r: r.id
    want = sorted(peers.with_peers(df, ["product"], ["a", "b"], ["a"], hot=10**9).collect(), key=key)
    monkeypatch.setattr(peers, "SHARES", most)
    got = peers.with_peers(df, ["product"], ["a", "b"], ["a"], hot=100, parts=5)
    assert sorted(got.select(*want[0].asDict()).collect(), key=key) == want
    # Ranks that are small are broadcast to the rows, others are joined by value.
    assert ("__value" in _plan(got)) == (most > 0)


def test_groups_of_ten_thousands_are_not_sorted_whole(spark):
    df = _rows(spark, 2, 60_000)
    assert "__value" in _plan(peers.with_peers(df, ["product"], ["a", "b"], ["a"]))


@pytest.mark.parametrize("name", ["quality_summary_stack", "work_queue_monitoring"])
def test_products_are_broadcast(spark, sf, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(catalog.QUERIES[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin \[product_group#\d+\], ", plan)


def test_transitions_shuffle_counts_only(spark, sf):
    plan = _plan(catalog.QUERIES["band_transitions"](spark, sf))
    last = plan.split("Exchange hashpartitioning(scenario_id", 1)
    assert len(last) == 2 and "partial_count" in last[1].split("Exchange", 1)[0] and plan.count("windowspecdefinition(firm_key") == plan.count("lag(hit")


@pytest.mark.parametrize("name", ["special_rows", "taxonomy_layouts", "notes_definitions"])
def test_rows_of_a_sheet_are_numbered_in_ranges(spark, sf, name):
    plan = _plan(catalog.QUERIES[name](spark, sf))
    assert "row_number()" not in plan and not re.search(r"SortMergeJoin \[workbook#\d+, sheet#\d+\], ", plan)


def test_pivot_shuffles_facts_once(spark):
    schema = "firm_key string, reporting_period string, source_reporting_period string, product_group string, canonical_sheet string, metric_name string, measurement_unit string, metric_value double, is_analysis_ready_value boolean, is_product_level boolean"
    row = lambda f, v, sheet="opened", metric="complaints_opened": (f, "2020-H1", "s", "p", sheet, metric, "count", v, True, True)
    wide = {r.firm_key: r for r in panel.pivot_facts(spark.createDataFrame([row("a", 1.0), row("a", 2.0, "closed", "complaints_closed"), row("b", None)], schema)).collect()}
    assert (wide["a"].complaints_opened_count, wide["a"].complaints_closed_count, wide["b"].complaints_opened_count) == (1.0, 2.0, None)
    for twice in ([row("a", 1.0), row("a", None)], [row("a", 1.0), row("a", 1.0, "consumer_credit")]):
        with pytest.raises(ContractError, match="two values for one feature"):
            panel.pivot_facts(spark.createDataFrame(twice, schema))
    with pytest.raises(ContractError, match="no feature"):
        panel.pivot_facts(spark.createDataFrame([row("a", 1.0, "odd")], schema))


def test_names_of_one_cell_are_dealt(spark):
    names = spark.range(600).select(F.format_string("firm %05d ltd", "id").alias("name"))
    cand = names.select(F.col("name").alias("key"), F.col("name").alias("candidate_name"), F.monotonically_increasing_id().alias("cid"))
    names, cand = cut(names.withColumn("key", F.col("name")).coalesce(1)), cut(cand)
    plan = _plan(shortlist.candidates_for(names, cand, ["candidate_name"], 20, common=50))
    assert not re.search(r"SortMergeJoin \[(a|b|len|own)#", plan) and plan.count("REPARTITION_BY_NUM") >= 2
