"""Releases: all tables or none, rules counted by the write, the last version left as it was."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from veldspar.contracts import ContractError
from veldspar.operators import packs
from veldspar.sources import releases


def _kv(spark, n, word="a"):
    return spark.range(n).select("id", F.lit(word).alias("w"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.array(F.struct("id")).alias("s"), F.current_timestamp().alias("t"), F.col("id").cast("decimal(12,2)").alias("d"))


def test_release_and_earlier_versions(spark, tmp_path):
    folder = str(tmp_path)
    first = releases.publish(spark, folder, {"x": _kv(spark, 10), "none": _kv(spark, 0)})
    assert (first.version, first.rows) == (1, {"x": 10, "none": 0})
    second = releases.publish(spark, folder, {"x": _kv(spark, 4, "b").repartition(3)})
    assert second.version == 2 and releases.versions(spark, folder) == [1, 2]
    assert releases.read(spark, folder, "x").count() == 4 and releases.read(spark, folder, "x", 1).filter("w = 'a'").count() == 10
    assert releases.read(spark, folder, "none", 1).schema == _kv(spark, 0).schema and releases.read(spark, folder, "none", 1).count() == 0
    old, want = (sorted(map(str, df.drop("t").collect())) for df in (releases.read(spark, folder, "x", 1), _kv(spark, 10)))
    assert old == want
    for missing in (lambda: releases.read(spark, folder, "none"), lambda: releases.read(spark, folder, "x", 3), lambda: releases.read(spark, f"{folder}/nowhere", "x")):
        with pytest.raises(ContractError):
            missing()


def test_failed_task_leaves_the_last_release(spark, tmp_path):
    folder = str(tmp_path)
    releases.publish(spark, folder, {"x": _kv(spark, 10), "y": _kv(spark, 5)})
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 97, F.raise_error(F.lit("task is lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="task is lost"):
        releases.publish(spark, folder, {"x": _kv(spark, 3), "y": broken})
    assert releases.versions(spark, folder) == [1]
    assert releases.read(spark, folder, "x").count() == 10 and releases.read(spark, folder, "y").count() == 5
    assert [len(list((tmp_path / t).glob("run=*"))) for t in "xy"] == [1, 1]  # nothing of the failed run is left
    told = {r.status: r for r in releases.runs(spark, folder).collect()}
    assert set(told) == {"released", "failed"} and "task is lost" in told["failed"].error


def test_files_of_a_task_that_ran_twice_are_no_part(spark, tmp_path):
    path = f"{tmp_path}/x/run=1"
    releases.write_run(_kv(spark, 10), path)
    stray = next((tmp_path / "x/run=1").glob("part-*"))
    (tmp_path / "x/run=1/part-00000-stray.parquet").write_bytes(stray.read_bytes())
    writer = releases.ReleaseWriter(path, _kv(spark, 0).schema)
    kept = [releases.Part(f["name"], f["rows"], f["bytes"]) for f in releases._manifest(path)["files"]]
    writer.commit([*kept, None, releases.Part(None, 0, 0)])
    assert not (tmp_path / "x/run=1/part-00000-stray.parquet").exists() and releases._manifest(path)["rows"] == 10
    writer.abort(kept)
    assert not (tmp_path / "x/run=1").exists()
    writer.abort([])  # nothing was written yet


def test_broken_rule_keeps_the_evidence(spark, tmp_path):
    folder, pack = str(tmp_path), {"x": (packs.Row("small", "id < 8"), packs.Row("known", "w = 'a'", "warning"))}
    assert releases.publish(spark, folder, {"x": _kv(spark, 5, "b")}, pack).issues == [{"table": "x", "severity": "warning", "rule": "known", "count": 5}]
    with pytest.raises(ContractError, match="small"):
        releases.publish(spark, folder, {"x": _kv(spark, 10)}, pack)
    assert releases.read(spark, folder, "x").count() == 5
    rejected = releases.runs(spark, folder).filter("status = 'rejected'").first()
    assert [(i.rule, i["count"]) for i in rejected.issues] == [("small", 2)]
    assert spark.read.parquet(f"{folder}/x/run={rejected.run}").count() == 10


def _rules(tables, packs_of, spark, folder):
    """Names and counts of all issues, whatever comes of the run."""
    try:
        return {(i["rule"], i["count"]) for i in releases.publish(spark, folder, tables, packs_of).issues}
    except ContractError:
        last = max(releases.runs(spark, folder).collect(), key=lambda r: len(r.issues or []))
        return {(i.rule, i["count"]) for i in last.issues}


METRIC = "reporting_period string, firm_name string, metric_name string, product_group string, measurement_unit string, source_workbook string, source_sheet string, source_row int, source_column int, value_status string, metric_value double"


def test_every_metric_rule_fires(spark, tmp_path):
    good = ("2025-H1", "Acme", "opened", "home", "count", "w", "s", 1, 2, "valid", 3.0)
    change = lambda **c: tuple(c.get(n.split(" ")[0], v) for n, v in zip(METRIC.split(", "), good))
    df = lambda *rows: spark.createDataFrame(list(rows), METRIC)
    assert _rules({"m": df(good, change(metric_value=None, value_status="missing"))}, {"m": packs.METRICS}, spark, f"{tmp_path}/good") == set()
    bad = [change(**{c: None}) for c in packs.REQUIRED] + [change(firm_name=""), change(metric_value=-1.0), change(metric_value=1.5), change(measurement_unit="percentage", metric_value=1.2), change(measurement_unit="percentage", metric_value=0.5)]
    want = {(f"required_{c}", 1 + (c == "firm_name")) for c in packs.REQUIRED} | {("non_negative_counts", 1), ("integer_counts", 1), ("percentage_expected_scale", 1)}
    assert _rules({"m": df(good, *bad)}, {"m": packs.METRICS}, spark, f"{tmp_path}/bad") == want
    assert _rules({"m": df(good).limit(0)}, {"m": packs.METRICS}, spark, f"{tmp_path}/none") == {("metrics_not_empty", 0)}


def test_every_fact_rule_fires(spark, tmp_path):
    dims = {"dim_firm": "firm_key", "dim_product_group": "product_key", "dim_metric": "metric_key", "dim_reporting_period": "reporting_period"}
    tables = {t: spark.createDataFrame([(f"{k}0",)], f"{k} string") for t, k in dims.items()}
    schema = "fact_id string, source_workbook string, source_sheet string, source_row int, source_column int, firm_key string, product_key string, metric_key string, reporting_period string, quality_review_status string"
    row = lambda i, n, **c: (i, "w", "s", n, c.get("column", 1), *[c.get(k, f"{k}0") for k in dims.values()], c.get("status", "not_flagged"))
    good = [row("a", 1), row("b", 2)]
    run = lambda rows, metrics, name: _rules(tables | {"metrics": spark.range(metrics), "fact": spark.createDataFrame(rows, schema)}, {"fact": packs.FACTS}, spark, f"{tmp_path}/{name}")
    assert run(good, 2, "good") == set()
    bad = [*good, row("a", 3), row("c", 2), row("d", 4, firm_key=""), row("e", 5, firm_key="x", product_key="x", metric_key=None), row("f", 6, reporting_period="x", status="pending_review")]
    assert run(bad, 9, "bad") == {("fact_row_count_preserved", 2), ("fact_id_unique", 2), ("source_cell_unique", 2), ("firm_key_complete", 1), ("firm_foreign_key_valid", 2), ("product_foreign_key_valid", 1), ("metric_foreign_key_valid", 1), ("period_foreign_key_valid", 1), ("pending_metric_quality_review", 1)}


def test_every_presentation_and_reconciliation_rule_fires(spark, tmp_path):
    one = lambda v, n: spark.createDataFrame([v], f"latest_reporting_period string, all_period_open_source_anomalies int").limit(n)
    queue = spark.createDataFrame([("kept",), (None,)], "review_disposition string")
    tables = {"executive_kpis": one((None, 2), 1), "priority_review_queue": queue, "executive_period_trend": spark.range(3), "executive_product_snapshot": spark.range(3)}
    want = {("latest_period_present", 1), ("single_open_source_anomaly", 1), ("priority_queue_has_expected_rows", 2), ("priority_queue_reviews_complete", 1), ("period_trend_has_expected_periods", 3), ("product_snapshot_has_expected_products", 3)}
    assert _rules(tables, packs.presentation(3, 4, 6), spark, f"{tmp_path}/bad") == want
    good = {"executive_kpis": one(("2025-H2", 1), 1), "priority_review_queue": queue.na.drop(), "executive_period_trend": spark.range(4), "executive_product_snapshot": spark.range(6)}
    assert _rules(good, packs.presentation(1, 4, 6), spark, f"{tmp_path}/good") == set()
    status = spark.createDataFrame([("matched",), ("mismatch",), ("not_comparable",), (None,)], "reconciliation_status string")
    assert _rules({"s": status, "t": status}, {"s": packs.SHEET_RECONCILIATION, "t": packs.TOTAL_RECONCILIATION}, spark, f"{tmp_path}/r") == {("sheet_record_reconciliation", 3), ("count_total_reconciliation", 1)}


def test_rules_are_counted_by_the_write_alone(spark, tmp_path):
    """One pass: rows are made once, though three rules look at them."""
    made = spark.sparkContext.accumulator(0)
    source = spark.range(50).rdd.map(lambda r: made.add(1) or (r.id,)).toDF("id long")
    release = releases.publish(spark, str(tmp_path), {"x": source}, {"x": (packs.Row("even", "id % 2 = 0", "warning"), packs.Row("low", "id < 45", "warning"), packs.Size("some", 1))})
    assert made.value == 50 and [(i["rule"], i["count"]) for i in release.issues] == [("even", 25), ("low", 5)]


def test_manifest_is_json(spark, tmp_path):
    releases.publish(spark, str(tmp_path), {"x": _kv(spark, 3)})
    told = json.loads(next((tmp_path / "x").glob("run=*/_manifest.json")).read_text())
    assert sum(f["rows"] for f in told["files"]) == told["rows"] == 3 and all(f["bytes"] > 0 for f in told["files"])
