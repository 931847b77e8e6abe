"""Star schema: keyed facts with quality review state, and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.contracts import checked_join
from veldspar.functions.semantics import collapse, stable_key

CELL = ["reporting_period", "source_workbook", "source_sheet", "source_row", "source_column"]


def firm_key(identifier, name):
    """FRN:<id>, or a stable key of the normalised name where there is none."""
    plain = F.regexp_replace(F.coalesce(identifier, F.lit("")), r"\.0$", "")
    return F.when(plain != "", F.concat(F.lit("FRN:"), plain)).otherwise(stable_key("NAME", F.lower(collapse(name))))


def facts(metrics: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Metric cells with keys and flags; a percentage outside 0..1 waits for review unless a decision covers the cell."""
    df = metrics.withColumns(
        {
            "firm_key": firm_key(F.col("resolved_frn"), F.col("firm_name")),
            "product_key": F.concat(F.lit("PRODUCT:"), "product_group"),
            "metric_key": stable_key("METRIC", F.col("canonical_sheet"), F.col("metric_name"), F.col("measurement_unit")),
            "fact_id": stable_key("FACT", *[F.col(c) for c in CELL[1:]], length=20),
        }
    )
    if decisions is not None:
        df = checked_join(df, decisions.select(*CELL, "quality_flag", "quality_review_status"), CELL, "left", "1:1")
    else:
        df = df.withColumns({"quality_flag": F.lit(None).cast("string"), "quality_review_status": F.lit(None).cast("string")})
    outlier = (F.col("measurement_unit") == "percentage") & (F.col("value_status") == "valid") & ~F.col("metric_value").between(0, 1)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    df = df.withColumns(
        {
            "quality_flag": F.when(outlier & empty("quality_flag"), "percentage_above_expected_range").otherwise(F.coalesce("quality_flag", F.lit(""))),
            "quality_review_status": F.when(~empty("quality_review_status"), F.col("quality_review_status")).when(outlier, "pending_review").otherwise("not_flagged"),
            "is_valid_value": F.col("value_status") == "valid",
            "is_product_level": F.col("product_group") != "grand_total",
        }
    )
    return df.withColumn("is_analysis_ready_value", F.col("is_valid_value") & (F.col("quality_review_status") != "pending_review"))


def firm_dim(observations: DataFrame) -> DataFrame:
    """Latest identity and coverage of each firm in one aggregation."""
    last = F.max_by(F.struct("resolved_frn", "firm_name", "match_status"), F.struct("reporting_period", "firm_name"))
    g = observations.groupBy("firm_key").agg(last.alias("l"), F.min("reporting_period").alias("first_reporting_period"), F.max("reporting_period").alias("last_reporting_period"), F.count_distinct("firm_name").alias("observed_name_count"))
    return g.select("firm_key", "l.resolved_frn", F.col("l.firm_name").alias("display_firm_name"), F.col("l.match_status").alias("identity_match_status"), "first_reporting_period", "last_reporting_period", "observed_name_count")


def latest_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last row of each group by `order` (ascending)."""
    w = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def metric_dim(fact: DataFrame) -> DataFrame:
    d = fact.select("metric_key", "canonical_sheet", "metric_name", "measurement_unit").distinct()
    return d.withColumns({"is_additive": F.col("measurement_unit") == "count", "metric_label": F.initcap(F.replace("metric_name", F.lit("_"), F.lit(" ")))})
