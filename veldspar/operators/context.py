"""External context: effective-dated rates, monthly series to half-years, keyword taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions.semantics import first_keyword, half_year, stable_key

#: Taxonomy classes with their keywords, first match wins.
CLASSES = [
    ("home_finance", "mortgage_or_home_finance_keyword", ["mortgage", "home finance"]),
    ("consumer_credit", "consumer_credit_keyword", ["consumer credit", "hire purchase", "payday", "credit broking"]),
    ("decumulation_and_pensions", "pension_or_annuity_keyword", ["pension", "annuit", "drawdown"]),
    ("investments", "investment_keyword", ["investment", "stock", "fund", "bond"]),
    ("insurance_and_pure_protection", "insurance_or_protection_keyword", ["insurance", "funeral plan", "protection"]),
    ("banking_and_credit_cards", "banking_or_payment_keyword", ["banking", "payment", "current account", "savings"]),
]


def rate_context(changes: DataFrame, periods: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each period the rate in force at start and end (both as of), extremes, change and decisions inside.

    `changes` (effective_date, rate, *by), `periods` (reporting_period, period_start, period_end; they don't overlap and are
    few, so they travel as one array). With `by`, each series is looked up on its own. A decision on the first day is both
    start rate and decision. Periods before the first rate are no rows, the period of the first rate may have null start.

    Each change is a row of the first period that ends on or after it, and of no other. One aggregation makes a row for
    each series and period with changes; what is in force then carries on over these few rows.
    """
    by = by or []
    at = F.array_sort(F.collect_list(F.struct("period_end", "period_start", "reporting_period")))
    c = changes.filter("effective_date IS NOT NULL AND rate IS NOT NULL").crossJoin(F.broadcast(periods.agg(at.alias("__p"))))  # one row
    when, rate = F.col("effective_date"), F.col("rate")
    c = c.withColumn("__i", F.size(F.filter("__p", lambda p: p["period_end"] < when))).withColumn("__start", F.get("__p", F.col("__i"))["period_start"])
    at_start, inside = when <= F.col("__start"), when >= F.col("__start")
    own = c.filter(F.col("__i") < F.size("__p")).groupBy(*by, "__i").agg(
        F.max_by(F.when(at_start, rate), F.when(at_start, when)).alias("s"), F.max_by(rate, when).alias("e"), F.min(F.when(inside, rate)).alias("lo"), F.max(F.when(inside, rate)).alias("hi"), F.count_if(inside).alias("n")
    )
    # Every series has a row for each period from its first change on.
    first = own.groupBy(*by).agg(F.min("__i").alias("__first"))
    slots = first.crossJoin(F.broadcast(periods.agg(at.alias("__p")))).select(*by, F.explode(F.sequence("__first", F.size("__p") - 1)).alias("__i"), "__p").withColumn("__q", F.get("__p", F.col("__i")))
    series = W.partitionBy(*by).orderBy("__i") if by else W.orderBy("__i")  # without `by` a row for each period
    keys = [*by, "__i"]
    j = slots.select(*keys, "__q.reporting_period", "__q.period_start", "__q.period_end").join(own, keys, "left")
    before = F.last("e", True).over(series.rowsBetween(W.unboundedPreceding, -1))
    j = j.withColumns({"start_rate": F.coalesce("s", before), "end_rate": F.last("e", True).over(series.rowsBetween(W.unboundedPreceding, 0))})
    return j.select(*by, "reporting_period", "period_start", "period_end", "start_rate", "end_rate", F.least("start_rate", "lo").alias("minimum_rate"), F.greatest("start_rate", "hi").alias("maximum_rate"), (F.col("end_rate") - F.col("start_rate")).alias("rate_change"), F.coalesce("n", F.lit(0)).cast("long").alias("rate_decision_count"))


def series_half_year(monthly: DataFrame) -> DataFrame:
    """Monthly (observation_date, indicator_name, indicator_value) to half-years; rounding is half-even."""
    d, v = F.col("observation_date"), F.col("indicator_value")
    g = monthly.filter(d.isNotNull() & v.isNotNull()).groupBy(half_year(d).alias("reporting_period"), "indicator_name").agg(
        F.avg(v).alias("period_mean"), F.max_by(v, d).alias("period_end_value"), F.min_by(v, d).alias("first_value"), F.min(v).alias("period_minimum"), F.max(v).alias("period_maximum"), F.count("*").alias("month_count")
    )
    change = F.col("period_end_value") - F.col("first_value")
    return g.select("reporting_period", "indicator_name", *[F.bround(c, 6).alias(c) for c in ("period_mean", "period_end_value", "period_minimum", "period_maximum")], F.bround(change, 6).alias("within_period_change"), "month_count")


def wide_series(df: DataFrame, title: str, columns: dict[str, str]) -> DataFrame:
    """A wide sheet with a 'yyyy MMM' title column to long rows, configured columns only."""
    date = F.try_to_timestamp(F.initcap(F.lower(F.col(title))), F.lit("yyyy MMM")).cast("date")
    one = df.select(date.alias("observation_date"), *[F.col(f"`{src}`").try_cast("double").alias(name) for name, src in columns.items()])
    return one.unpivot(["observation_date"], list(columns), "indicator_name", "indicator_value").na.drop()


def mapping_template(taxonomy: DataFrame, columns: list[str], prefix: str = "TAX") -> DataFrame:
    """Distinct taxonomy rows with a conservative suggestion that waits for review."""
    text = F.concat_ws(" ", *columns)
    s = first_keyword(text, CLASSES, ("", "no_safe_suggestion"))
    return taxonomy.select(stable_key(prefix, *[F.col(c) for c in columns], length=10, algorithm="sha1").alias("mapping_id"), *columns, s["label"].alias("suggested_group"), s["basis"].alias("suggestion_basis"), F.lit("pending_review").alias("review_decision")).dropDuplicates(["mapping_id"])
