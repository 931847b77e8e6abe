"""Review workflows: stratified samples, methodology comparison, priority reviews, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.contracts import ContractError, checked_join, require_columns
from veldspar.plans.rules import OBS

OUTCOMES = ("coherent_priority_case", "likely_false_positive", "potential_false_negative", "needs_more_context")


def select_sample(summary: DataFrame, per_band: int = 5) -> DataFrame:
    """The first `per_band` current observations of each band, strongest first; data-poor ones by triggers, then coverage."""
    latest = F.broadcast(summary.agg(F.max("reporting_period").alias("reporting_period")))  # one row
    poor = F.col("priority_band") == "insufficient_data"
    order = W.partitionBy("priority_band").orderBy(
        F.when(poor, -F.col("triggered_rule_count")).otherwise(-F.col("warning_score")),
        F.when(poor, F.col("eligible_rule_count")).otherwise(-F.col("triggered_rule_count")),
        F.col("display_firm_name").asc_nulls_last(),
        "product_group",
    )
    ranked = summary.join(latest, "reporting_period", "left_semi").withColumn("band_rank", F.row_number().over(order))
    return ranked.filter(F.col("band_rank") <= per_band).withColumn("review_status", F.lit("pending_case_review"))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bands and scores of two methodologies side by side."""
    side = lambda df, s: df.select(*OBS, *[F.col(c).alias(f"{c}_{s}") for c in ("warning_score", "priority_band", "triggered_rule_ids")])
    both = checked_join(side(first, "v1"), side(second, "v2"), OBS, "inner", "1:1", large=True)
    return both.withColumns({"band_changed": F.col("priority_band_v1") != F.col("priority_band_v2"), "score_change": F.col("warning_score_v2") - F.col("warning_score_v1")})


def alignment(outcome: Column, band: Column) -> Column:
    """Whether the revised band agrees with a reviewer's outcome."""
    says = lambda ok: F.when(ok, "aligned").otherwise("needs_review")
    return (
        F.when(outcome == "coherent_priority_case", says(band == "priority_review"))
        .when(outcome == "likely_false_positive", says(band.isin("no_current_signal", "monitor", "insufficient_data")))
        .when(outcome == "potential_false_negative", says(band.isin("monitor", "review", "priority_review")))
        .otherwise("not_targeted_by_revision")
    )


def review_flags() -> Column:
    """Pipe-joined reasons to go back to the source."""
    outside = ~F.col("closed_within_8_weeks_pct").between(0, 1)
    large = (F.col("context_provision_rate") > 1000) | (F.col("context_intermediation_rate") > 1000)
    return F.concat_ws(
        "|",
        F.when(F.col("complaints_closed_count") < 50, "low_closed_denominator_20_to_49"),
        F.when(outside, "closure_percentage_outside_0_to_100"),
        F.when(large, "context_rate_above_1000_check_units"),
        F.when(F.coalesce(F.col("identity_match_status"), F.lit("")) != "matched", "firm_identity_unmatched"),
    )


def priority_reviews(summary: DataFrame, indicators: DataFrame, features: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Priority observations with families, flags, disposition and comment; a source resolution overrides the disposition."""
    sorted_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    families = indicators.filter("triggered").groupBy(*OBS).agg(
        F.count_distinct("score_family").alias("independent_signal_family_count"), sorted_set(F.col("score_family")).alias("triggered_signal_families"), sorted_set(F.when(F.col("persistent_trigger"), F.col("rule_id"))).alias("persistent_trigger_ids")
    )
    wanted = features.select(*OBS, "complaints_closed_count", "closed_within_8_weeks_pct", "context_provision_rate", "context_intermediation_rate", "identity_match_status")
    df = checked_join(checked_join(summary.filter("priority_band = 'priority_review'"), families, OBS, large=True), wanted, OBS, large=True)
    df = df.withColumn("review_flags", review_flags())
    strong = (F.col("independent_signal_family_count") >= 3) | (F.col("warning_score") >= 9)
    df = df.withColumn("review_disposition", F.when(F.col("review_flags") != "", "source_check_required_before_reliance").when(strong, "retain_priority_review").otherwise("retain_priority_review_borderline"))
    if resolutions is not None:
        keys = ["reporting_period", "display_firm_name", "product_group"]
        df = checked_join(df, require_columns(resolutions, [*keys, "resolved_disposition"]), keys, "left", "m:1")
        df = df.withColumn("review_disposition", F.coalesce("resolved_disposition", "review_disposition"))
    said = F.format_string("Score %d from %d rules in %d families (%s).", "warning_score", "triggered_rule_count", "independent_signal_family_count", "triggered_signal_families")
    return df.withColumn("review_comment", F.concat(said, F.when(F.col("persistent_trigger_ids") != "", F.concat(F.lit(" Persistent: "), "persistent_trigger_ids", F.lit("."))).otherwise(" Nothing persisted.")))


def merge_decisions(sample: DataFrame, decisions: DataFrame, keys: list[str] = OBS, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """Decisions must cover the sampled keys exactly, with known outcomes and reviewer metadata."""
    require_columns(decisions, [*keys, "review_outcome", "reviewer", "reviewed_at", "review_comment"])
    if decisions.filter(~F.col("review_outcome").isin(*outcomes)).head(1):
        raise ContractError("unknown review outcome")
    if decisions.filter("coalesce(reviewer, '') = '' OR coalesce(reviewed_at, '') = ''").head(1):
        raise ContractError("a decision lacks reviewer or date")
    if sample.join(decisions, keys, "left_anti").head(1) or decisions.join(sample, keys, "left_anti").head(1):
        raise ContractError("decisions must cover the sampled cases exactly")
    base = sample.drop("review_status", "reviewer", "reviewed_at", "review_comment", "review_outcome")
    return checked_join(base, decisions, keys, "left", "1:1")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Contingency table with 0 for empty cells; null keys don't count."""
    return df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).pivot(column, values).count().na.fill(0)
