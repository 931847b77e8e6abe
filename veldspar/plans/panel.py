"""Panel features: long facts to a wide panel, trends, peer statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.contracts import ContractError
from veldspar.functions.semantics import half_year, period_end, period_start, safe_ratio, window_bounds
from veldspar.plans import peers
from veldspar.store import cut, named, table

OBS = ["firm_key", "reporting_period", "source_reporting_period", "product_group"]
PEER = ["reporting_period", "product_group"]
#: Fixed values: (sheet role, metric, unit) to feature.
FEATURES = {
    ("opened", "complaints_opened", "count"): "complaints_opened_count",
    ("closed", "complaints_closed", "count"): "complaints_closed_count",
    ("consumer_credit", "complaints_opened", "count"): "complaints_opened_count",
    ("consumer_credit", "complaints_closed", "count"): "complaints_closed_count",
    ("consumer_credit", "complaints_upheld", "count"): "complaints_upheld_count",
    ("consumer_credit", "complaints_upheld", "percentage"): "complaints_upheld_pct",
    ("percentage_upheld", "complaints_upheld", "percentage"): "complaints_upheld_pct",
    ("percentage_within_3_days", "closed_within_3_days", "percentage"): "closed_within_3_days_pct",
    ("percentage_after_3_days_within_8_weeks", "closed_after_3_days_within_8_weeks", "percentage"): "closed_after_3_days_within_8_weeks_pct",
    ("context_provision", "complaints_in_context", "context_rate"): "context_provision_rate",
    ("context_intermediation", "complaints_in_context", "context_rate"): "context_intermediation_rate",
}
#: Features that have trends and peer statistics.
TREND = ["complaints_opened_count", "context_provision_rate", "context_intermediation_rate", "complaints_upheld_pct", "closed_within_3_days_pct", "closed_after_3_days_within_8_weeks_pct"]


def pivot_facts(fact: DataFrame) -> DataFrame:
    """Analysis-ready product-level facts to one row per observation; unknown triples and collisions are errors.

    Facts are read and shuffled once, as one row for each observation: it holds whether a feature met twice. Only an error looks at them again.
    """
    spark = fact.sparkSession
    known = F.broadcast(spark.createDataFrame([(*k, v) for k, v in FEATURES.items()], "canonical_sheet string, metric_name string, measurement_unit string, feature string"))
    ready = fact.filter("is_analysis_ready_value AND is_product_level").join(known, ["canonical_sheet", "metric_name", "measurement_unit"], "left")
    features = sorted(set(FEATURES.values()))
    is_it = [F.col("feature") == f for f in features]
    values = [F.max(F.when(c, F.col("metric_value"))).alias(f) for f, c in zip(features, is_it)]  # of one value
    wrong = F.greatest(F.count_if(F.col("feature").isNull()) > 0, *[F.count_if(c) > 1 for c in is_it])
    wide = cut(ready.groupBy(*OBS).agg(*values, wrong.alias("__wrong")), "panel-wide")
    if wide.filter("__wrong").head(1):
        triple = F.concat_ws(" / ", "canonical_sheet", "metric_name", "measurement_unit")
        cells = ready.groupBy(*OBS, "feature").agg(F.count("*").alias("n"), F.min(triple).alias("triple"), F.first("metric_value").alias("metric_value"))
        bad = cells.filter("feature IS NULL OR n > 1").first()
        raise ContractError(f"{'no feature' if bad['feature'] is None else 'two values for one feature'}: {bad.asDict()}")
    return wide.drop("__wrong")


def add_trends(panel: DataFrame, features: list[str] = TREND) -> DataFrame:
    """Window bounds, and for each feature the previous observation's value, the change and the relative change.

    Previous means the previous observation of the firm and product, whatever gap lies between; one exchange and one
    sort serve all features.
    """
    start, end = window_bounds(F.col("source_reporting_period"))
    df = panel.withColumns({"observation_start": start, "observation_end": end}).withColumn("observation_days", F.datediff("observation_end", "observation_start") + 1)
    order = W.partitionBy("firm_key", "product_group").orderBy(F.col("observation_end").asc_nulls_last(), "reporting_period", "source_reporting_period")
    df = df.withColumns({f"previous_{f}": F.lag(f).over(order) for f in features})
    change = {f"change_{f}": F.col(f) - F.col(f"previous_{f}") for f in features}
    return df.withColumns(change | {f"pct_change_{f}": safe_ratio(F.col(f) - F.col(f"previous_{f}"), F.col(f"previous_{f}")) for f in features})


def add_percentiles(df: DataFrame, features: list[str] = TREND) -> DataFrame:
    return peers.with_peers(df, PEER, features)


def benchmarks(df: DataFrame, features: list[str] = TREND) -> DataFrame:
    """Median and exact quartiles for each period and product."""
    return peers.quantiles(df, PEER, features, {"q1": 0.25, "median": 0.5, "q3": 0.75})


#: Tables that the panel of order lines is made of.
ORDER_TABLES = ("lineitem", "orders", "part")


def order_sources(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{n}.parquet" for n in ORDER_TABLES]


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel that order lines host, supplier x part type x half-year of the order; a named table."""
    return named(spark, "order-panel", order_sources(sf_dir), lambda: _order_panel(spark, sf_dir))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with trends; a named table."""
    return named(spark, "order-features", order_sources(sf_dir), lambda: add_trends(order_panel(spark, sf_dir)))


def _order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    closed, back = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    share = lambda cond: F.count_if(cond) / F.count("*")
    keys = [F.concat(F.lit("SUPP:"), F.col("l_suppkey").cast("string")).alias("firm_key"), F.col("p_type").alias("product_group"), half_year(F.to_date("o_orderdate")).alias("reporting_period")]
    obs = lines.groupBy(*keys).agg(
        F.count("*").cast("double").alias("complaints_opened_count"),
        F.count_if(closed).cast("double").alias("complaints_closed_count"),
        safe_ratio(F.count_if(closed & back).cast("double"), F.count_if(closed).cast("double")).alias("complaints_upheld_pct"),
        share(F.col("l_discount") < 0.035).alias("closed_within_3_days_pct"),
        share((F.col("l_discount") >= 0.035) & (F.col("l_discount") < 0.085)).alias("closed_after_3_days_within_8_weeks_pct"),
        (1000.0 * F.count("*") / F.sum("l_quantity")).alias("context_provision_rate"),
        (1000.0 * F.count_if(back) / F.sum("l_quantity")).alias("context_intermediation_rate"),
    )
    period = F.col("reporting_period")
    window = F.concat(period_start(period).cast("string"), F.lit(" to "), period_end(period).cast("string"))
    return obs.withColumn("source_reporting_period", window)
