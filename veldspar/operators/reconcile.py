"""Additive and structural reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(metrics: DataFrame, keys: list[str], total: str = "grand_total") -> DataFrame:
    """Reported total against the sum of valid components for each key, from count rows only."""
    is_total, valid = F.col("product_group") == total, F.col("value_status") == "valid"
    g = metrics.filter("measurement_unit = 'count'").groupBy(*keys).agg(
        F.count_if(is_total).alias("t"), F.max(F.when(is_total, F.col("metric_value"))).alias("reported_total"), F.max(F.when(is_total, F.col("value_status"))).alias("total_status"),
        F.count_if(~is_total).alias("component_count"), F.count_if(~is_total & valid).alias("valid_component_count"), F.coalesce(F.sum(F.when(~is_total & valid, F.col("metric_value"))), F.lit(0.0)).alias("s"),
    ).filter("t > 0")
    why = F.when(F.col("total_status") != "valid", "reported_total_not_valid").when(F.col("component_count") == 0, "no_product_components").when(F.col("component_count") != F.col("valid_component_count"), "one_or_more_components_missing")
    difference = F.when(why.isNull(), F.col("reported_total") - F.col("s"))
    return g.select(*keys, "component_count", "valid_component_count", "reported_total", F.when(why.isNull(), F.col("s")).alias("calculated_total"), difference.alias("difference"),
                    F.when(why.isNotNull(), "not_comparable").when(F.abs(difference) < 1e-9, "matched").otherwise("mismatch").alias("reconciliation_status"),
                    F.coalesce(why, F.when(F.abs(difference) >= 1e-9, "reported_total_differs_from_component_sum"), F.lit("")).alias("reconciliation_reason"))


def structure(records: DataFrame, keys: list[str]) -> DataFrame:
    """Whether extracted records are rows x columns of their sheet."""
    g = records.groupBy(*keys).agg(F.count_distinct("source_row").alias("rows"), F.count_distinct("source_column").alias("columns"), F.count("*").alias("records"))
    return g.withColumn("expected_records", F.col("rows") * F.col("columns")).withColumn("reconciliation_status", F.when(F.col("records") == F.col("expected_records"), "matched").otherwise("mismatch"))
