"""Reporting marts, presentation tables and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.contracts import ContractError, checked_join
from veldspar.functions.semantics import period_end, period_start, safe_ratio
from veldspar.plans import peers
from veldspar.plans.rules import BANDS, OBS
from veldspar.plans.scan import scan
from veldspar.store import settled

NOTICE = "Prioritisation only, no finding; pending business approval."


def _latest(df: DataFrame) -> DataFrame:
    return F.broadcast(df.agg(F.max("reporting_period").alias("reporting_period")))  # one row


def _joined(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), "|")


def product_dim(products: DataFrame) -> DataFrame:
    """Products in name order with a label; a dimension of a few rows."""
    label = F.initcap(F.replace("product_group", F.lit("_"), F.lit(" ")))
    return products.select("product_group", label.alias("product_group_label"), F.row_number().over(W.orderBy("product_group")).alias("display_order"))


def period_dim(periods: DataFrame) -> DataFrame:
    """Half-years with bounds and the previous one that occurs; a dimension of a few rows."""
    p = F.col("reporting_period")
    return periods.select(p, F.substring(p, 1, 4).cast("int").alias("year"), F.substring(p, -1, 1).cast("int").alias("half"), period_start(p).alias("period_start"), period_end(p).alias("period_end"), F.lag(p).over(W.orderBy(p)).alias("previous_reporting_period"))


def firm_product(summary: DataFrame, periods: DataFrame, products: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """One row per observation with dimensions, review state and flags."""
    df = summary
    if reviews is not None:
        df = checked_join(df, reviews.select(*OBS, *[c for c in reviews.columns if c not in summary.columns]), OBS, "left", "1:1")
    if "review_disposition" not in df.columns:
        df = df.withColumn("review_disposition", F.lit(None).cast("string"))
    df = checked_join(df, F.broadcast(periods), ["reporting_period"], "inner", "m:1")
    df = checked_join(df, F.broadcast(products), ["product_group"], "inner", "m:1")  # a row for each product: shuffled by it, a task would get all rows of some
    last = F.broadcast(periods.agg(F.max_by("reporting_period", "period_end").alias("__last")))
    order = F.create_map(*[x for i, b in enumerate(BANDS, 1) for x in (F.lit(b), F.lit(i))])
    priority, anomaly = F.col("priority_band") == "priority_review", F.coalesce(F.col("review_disposition") == "source_anomaly_requires_business_review", F.lit(False))
    return df.crossJoin(last).withColumns(
        {
            "priority_band_sort_order": order[F.col("priority_band")],
            "has_current_signal": F.col("triggered_rule_count") > 0,
            "is_priority_review": priority,
            "is_source_anomaly": anomaly,
            # the last assignment wins, so it comes first here
            "review_display_status": F.when(anomaly, "source_anomaly_open").when(priority & F.col("review_disposition").isNotNull(), "analytical_review_complete").when(priority, "priority_review_pending").otherwise("not_required"),
            "is_latest_reporting_period": F.col("reporting_period") == F.col("__last"),
            "methodology_notice": F.lit(NOTICE),
        }
    ).drop("__last")


def firm_period(product: DataFrame) -> DataFrame:
    return product.groupBy("firm_key", "reporting_period").agg(
        F.min("display_firm_name").alias("display_firm_name"), F.count("*").alias("product_observation_count"), F.count_if("has_current_signal").alias("products_with_current_signal"), F.max("warning_score").alias("maximum_warning_score"),
        F.sum("triggered_rule_count").alias("total_triggered_rules"), F.sum("persistent_rule_count").alias("total_persistent_rules"), *[F.count_if(F.col("priority_band") == b).alias(f"{b}_product_count") for b in BANDS],
        _joined(F.when(F.col("is_priority_review"), F.col("product_group"))).alias("priority_review_products"), (F.count_if("is_priority_review") > 0).alias("has_priority_review_product"),
    )


def rule_detail(indicators: DataFrame, product: DataFrame) -> DataFrame:
    context = product.select(*OBS, *[c for c in ("product_group_label", "priority_band", "priority_band_sort_order", "warning_score", "coverage_status", "review_disposition", "is_latest_reporting_period") if c in product.columns])
    status = F.when(F.col("persistent_trigger"), "triggered_persistent").when(F.col("triggered"), "triggered").when(~F.col("eligible"), "ineligible").otherwise("not_triggered")
    return checked_join(indicators, context, OBS, "inner", "m:1", large=True).withColumn("rule_status", status)


def metric_detail(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Source cells with their address."""
    cell = F.concat("source_sheet", F.lit("!R"), F.col("source_row").cast("string"), F.lit("C"), F.col("source_column").cast("string"))
    return checked_join(fact, products.select("product_group", "product_group_label"), ["product_group"], "left", "m:1").withColumns({"metric_display_value": F.col("metric_value"), "source_cell": cell})


def kpis(product: DataFrame) -> DataFrame:
    return product.filter("is_latest_reporting_period").agg(
        F.max("reporting_period").alias("latest_reporting_period"), F.count_distinct("firm_key").alias("latest_firm_count"), F.count("*").alias("latest_firm_product_observations"), F.count_if("is_priority_review").alias("latest_priority_observations"),
        F.count_distinct(F.when(F.col("is_priority_review"), F.col("firm_key"))).alias("latest_priority_firms"), F.count_if(F.col("priority_band") == "insufficient_data").alias("latest_insufficient_data_observations"),
    )


def trend(product: DataFrame) -> DataFrame:
    return product.groupBy("reporting_period").agg(F.count_distinct("firm_key").alias("firm_count"), F.count("*").alias("observation_count"), *[F.count_if(F.col("priority_band") == b).alias(b) for b in BANDS])


def snapshot(product: DataFrame) -> DataFrame:
    return product.filter("is_latest_reporting_period").groupBy("product_group", "display_order").agg(F.count("*").alias("firm_observations"), *[F.count_if(F.col("priority_band") == b).alias(b) for b in BANDS if b != "no_current_signal"])


def stacked(df: DataFrame, measures: dict[str, Column], name: str = "quality_measure", value: str = "observation_count") -> DataFrame:
    """One row per named condition with its count; one pass."""
    one = df.agg(*[F.count_if(c).alias(f"m{i}") for i, c in enumerate(measures.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias(name), F.col(f"m{i}").alias(value)) for i, n in enumerate(measures)])).alias("r")).select("r.*")


def persistent_cases(product: DataFrame, count: int, exact: bool = False) -> DataFrame:
    """The current priority cases with most priority periods, numbered; with `exact`, fewer than `count` is an error."""
    keys = ["firm_key", "product_group"]
    priority = product.filter("is_priority_review")
    history = priority.groupBy(*keys).agg(F.count_distinct("reporting_period").alias("priority_periods"), F.min("reporting_period").alias("first_priority_period"), F.max("reporting_period").alias("last_priority_period"), F.max("warning_score").alias("maximum_warning_score"), F.count_if(F.col("persistent_rule_count") > 0).alias("periods_with_persistent_rules"))
    latest = priority.filter("is_latest_reporting_period").select(*keys, "display_firm_name", F.col("warning_score").alias("latest_warning_score"), "triggered_rule_ids", "coverage_status")
    order = [F.desc("priority_periods"), F.desc("latest_warning_score"), F.col("display_firm_name").asc_nulls_last(), F.col("product_group")]
    top = checked_join(latest, history, keys).orderBy(*order).limit(count)  # top-k before numbering: the window sees `count` rows
    if exact and top.count() != count:
        raise ContractError(f"expected {count} persistent cases")
    return top.withColumn("case_id", F.format_string("PCR-%03d", F.row_number().over(W.orderBy(*order))))


CASE_KEYS = ["firm_key", "product_group"]


def case_periods(cases: DataFrame, product: DataFrame) -> DataFrame:
    """All periods of the selected cases; `cases` is a top-k result, so it is broadcast."""
    return checked_join(product, F.broadcast(cases.select("case_id", *CASE_KEYS)), CASE_KEYS, "inner", "m:1")


def case_rules(cases: DataFrame, indicators: DataFrame) -> DataFrame:
    """Every rule that fired for the selected cases, with its evidence."""
    return checked_join(indicators.filter("triggered"), F.broadcast(cases.select("case_id", *CASE_KEYS)), CASE_KEYS, "inner", "m:1")


def case_decisions(cases: DataFrame) -> DataFrame:
    """The ledger that people fill in, one row for each case; see `files.write_template`."""
    empty = [F.lit("").alias(c) for c in ("owner", "management_decision", "decision_rationale", "evidence_reference", "reviewer", "reviewed_at")]
    return cases.select("case_id", *CASE_KEYS, F.lit("not_started").alias("review_status"), *empty)


def checked_case_decisions(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Decisions cover the cases exactly; a completed one has a decision, its rationale, evidence and reviewer."""
    if decisions.join(cases, "case_id", "left_anti").head(1) or cases.join(decisions, "case_id", "left_anti").head(1) or decisions.groupBy("case_id").count().filter("count > 1").head(1):
        raise ContractError("decisions must cover the cases exactly")
    needed = ("management_decision", "decision_rationale", "evidence_reference", "reviewer", "reviewed_at")
    lacks = F.greatest(*[F.coalesce(F.trim(c), F.lit("")) == "" for c in needed])
    if bad := decisions.filter((F.col("review_status") == "completed") & lacks).select("case_id").collect():
        raise ContractError(f"completed without decision, rationale, evidence or reviewer: {sorted(r['case_id'] for r in bad)}")
    return decisions


def rule_drivers(indicators: DataFrame) -> DataFrame:
    """What fired in the latest period, and how much of it persisted."""
    current = indicators.join(_latest(indicators), "reporting_period", "left_semi").filter("triggered")
    out = current.groupBy("rule_id", "rule_category", "score_family").agg(F.count("*").alias("triggered_observations"), F.count_if("persistent_trigger").alias("persistent_triggers"), F.count_distinct("product_group").alias("product_groups"))
    return out.withColumn("persistent_share", safe_ratio(F.col("persistent_triggers"), F.col("triggered_observations")))


def insufficient_queue(summary: DataFrame, indicators: DataFrame) -> DataFrame:
    """Current observations that can't be classified: why, in which families, and what to do."""
    poor = summary.join(_latest(summary), "reporting_period", "left_semi").filter("priority_band = 'insufficient_data'").select(*OBS, "eligible_rule_count")
    gaps = indicators.join(_latest(indicators), "reporting_period", "left_semi").filter("NOT eligible").groupBy(*OBS).agg(
        F.count_if(F.col("eligibility_reason") == "missing_required_feature").alias("missing_required_feature"), F.count_if(F.col("eligibility_reason") == "peer_group_below_minimum").alias("peer_group_below_minimum"), _joined(F.col("score_family")).alias("ineligible_signal_families")
    )
    df = checked_join(poor, gaps, OBS, "left", "1:1", large=True).na.fill(0, ["missing_required_feature", "peer_group_below_minimum"])
    return df.withColumn("recommended_treatment", F.when(F.col("peer_group_below_minimum") > 0, "review_peer_group_minimum_and_do_not_classify").otherwise("restore_or_source_missing_features"))


def coverage_gaps(queue: DataFrame) -> DataFrame:
    """Per product: current insufficient observations, those without an eligible rule, and those with one or two."""
    n = F.col("eligible_rule_count")
    return queue.groupBy("product_group").agg(F.count("*").alias("insufficient_observations"), F.count_if(n == 0).alias("zero_eligible_rules"), F.count_if(n.isin(1, 2)).alias("one_or_two_eligible_rules"))


def priority_queue(product: DataFrame) -> DataFrame:
    """Current priority observations, numbered by score and name: over ranges, no single task sees all."""
    current = product.filter("is_latest_reporting_period AND is_priority_review")
    order = [F.desc("warning_score"), F.col("display_firm_name").asc_nulls_last(), F.col("product_group"), F.col("firm_key")]
    return scan(current, [], order, sums={"queue_position": F.lit(1)}, name="queue").withColumn("queue_position", F.col("queue_position").cast("int"))


def monitoring_queue(product: DataFrame, indicators: DataFrame, product_group: str) -> DataFrame:
    """Current monitor and review observations of one product with the ids of the rules that fired."""
    watched = product.filter(F.col("is_latest_reporting_period") & (F.col("product_group") == product_group) & F.col("priority_band").isin("monitor", "review"))
    fired = indicators.filter(F.col("triggered") & (F.col("product_group") == product_group)).groupBy(*OBS).agg(_joined(F.col("rule_id")).alias("triggered_rule_ids_rebuilt"))
    return checked_join(watched, fired, OBS, "left", "1:1", large=True)


def product_period(panel: DataFrame, medians: list[str]) -> DataFrame:
    """Counts are summed, shares and rates are medians over firms; change against the product's previous period."""
    keys = ["reporting_period", "product_group"]
    panel = settled(panel, "context-panel")
    g = panel.groupBy(*keys).agg(F.count("*").alias("firm_observation_count"), F.count_distinct("firm_key").alias("distinct_firm_count"), F.coalesce(F.sum("complaints_opened_count"), F.lit(0.0)).alias("complaints_opened_total"))
    middle = peers.quantiles(panel, keys, medians, {"median": 0.5})
    g = checked_join(g, middle.drop(*[f"{f}_count" for f in medians]), keys)
    g = g.withColumn("previous_total", F.lag("complaints_opened_total").over(W.partitionBy("product_group").orderBy("reporting_period")))
    return g.withColumns({"change_total": F.col("complaints_opened_total") - F.col("previous_total"), "pct_change_total": safe_ratio(F.col("complaints_opened_total") - F.col("previous_total"), F.col("previous_total"))})
