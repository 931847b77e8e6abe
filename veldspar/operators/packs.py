"""Rule packs: the rules of a table as data, counted by the same pass that writes it.

A pack is a tuple of rules. `observed` adds what rules on keys need to the plan (a window for uniqueness, a flagged join for
references), counts violations by `DataFrame.observe`, and takes the additions away again; whoever writes the rows gets all counts with
the write, and no table is read for its rules.

An observation counts rows once even where an executor is lost: metrics of a task count when it succeeds. Reuse of a plan's
exchange does not count twice, since the observation stands above all exchanges of its table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Row:
    """Every row meets an SQL condition; null is a violation."""

    rule: str
    holds: str
    severity: str = "error"


@dataclass(frozen=True)
class Unique:
    """No other row has the same keys."""

    rule: str
    keys: tuple[str, ...]
    severity: str = "error"


@dataclass(frozen=True)
class Refers:
    """The column's value is among those of a column of another table of the same run."""

    rule: str
    column: str
    table: str
    key: str
    severity: str = "error"


@dataclass(frozen=True)
class Size:
    """The table has a number of rows in these bounds."""

    rule: str
    least: int = 0
    most: int | None = None
    severity: str = "error"


@dataclass(frozen=True)
class AsMany:
    """The table has as many rows as another one of the same run."""

    rule: str
    table: str
    severity: str = "error"


@dataclass
class Observed:
    rows: DataFrame
    pack: tuple
    observation: Observation | None

    def issues(self, written: int) -> list[dict]:
        """(severity, rule, count) of the rules that are broken; to be asked for when the rows are written."""
        counts = self.observation.get if self.observation else {}
        out = [{"severity": r.severity, "rule": r.rule, "count": counts[r.rule]} for r in self.pack if counts.get(r.rule)]
        sized = [r for r in self.pack if isinstance(r, Size)]
        return out + [{"severity": r.severity, "rule": r.rule, "count": written} for r in sized if written < r.least or r.most is not None and written > r.most]


def observed(df: DataFrame, pack: tuple, tables: dict[str, DataFrame] | None = None) -> Observed:
    """`df`, unchanged, with the violations of its pack counted by whatever action runs over it first."""
    columns, counts = df.columns, []
    for i, rule in enumerate(pack):
        if isinstance(rule, Row):
            broken: Column = ~F.coalesce(F.expr(rule.holds), F.lit(False))
        elif isinstance(rule, Unique):
            df = df.withColumn(f"__rule{i}", F.count(F.lit(1)).over(W.partitionBy(*rule.keys)))
            broken = F.col(f"__rule{i}") > 1
        elif isinstance(rule, Refers):
            known = (tables or {})[rule.table].select(F.col(rule.key).alias(rule.column)).distinct().withColumn(f"__rule{i}", F.lit(True))
            df = df.join(known, rule.column, "left")
            broken = F.col(f"__rule{i}").isNull()
        else:
            continue
        counts.append(F.count_if(broken).alias(rule.rule))
    if not counts:
        return Observed(df, pack, None)
    seen = Observation()
    return Observed(df.observe(seen, *counts).select(*[F.col(f"`{c}`") for c in columns]), pack, seen)


def across(rows: dict[str, int], packs_of: dict[str, tuple]) -> list[dict]:
    """Broken rules between the sizes of tables."""
    rules = [(name, r) for name, pack in packs_of.items() for r in pack if isinstance(r, AsMany)]
    return [{"severity": r.severity, "rule": r.rule, "count": abs(rows[name] - rows[r.table]), "table": name} for name, r in rules if rows[name] != rows[r.table]]


def table_of(spark, issues: list[dict]) -> DataFrame:
    """Issues as a table (severity, rule, count): a row for each broken rule."""
    return spark.createDataFrame([(i["severity"], i["rule"], i["count"]) for i in issues], "severity string, rule string, count long")


# ---- fixed values: the rules of each stage, their names and severities ------------------------------------------------

REQUIRED = ("reporting_period", "firm_name", "metric_name", "product_group", "measurement_unit", "source_workbook", "source_sheet", "source_row", "source_column")
#: Metric cells as extracted.
METRICS = (
    Size("metrics_not_empty", least=1),
    *[Row(f"required_{c}", f"coalesce(cast({c} AS string), '') <> ''") for c in REQUIRED],
    Row("non_negative_counts", "NOT coalesce(value_status = 'valid' AND measurement_unit = 'count' AND metric_value < 0, false)"),
    Row("integer_counts", "NOT coalesce(value_status = 'valid' AND measurement_unit = 'count' AND abs(metric_value % 1) > 1e-9, false)"),
    Row("percentage_expected_scale", "NOT coalesce(value_status = 'valid' AND measurement_unit = 'percentage' AND metric_value NOT BETWEEN 0 AND 1, false)", "warning"),
)
#: Records of each sheet against what was extracted, and reported totals against the sum of their parts.
SHEET_RECONCILIATION = (Row("sheet_record_reconciliation", "reconciliation_status = 'matched'"),)
TOTAL_RECONCILIATION = (Row("count_total_reconciliation", "coalesce(reconciliation_status, '') <> 'mismatch'", "warning"),)
#: Facts of the star schema; its dimensions are tables of the same run.
FACTS = (
    AsMany("fact_row_count_preserved", "metrics"),
    Unique("fact_id_unique", ("fact_id",)),
    Unique("source_cell_unique", ("source_workbook", "source_sheet", "source_row", "source_column")),
    Row("firm_key_complete", "firm_key <> ''"),
    Refers("firm_foreign_key_valid", "firm_key", "dim_firm", "firm_key"),
    Refers("product_foreign_key_valid", "product_key", "dim_product_group", "product_key"),
    Refers("metric_foreign_key_valid", "metric_key", "dim_metric", "metric_key"),
    Refers("period_foreign_key_valid", "reporting_period", "dim_reporting_period", "reporting_period"),
    Row("pending_metric_quality_review", "quality_review_status <> 'pending_review'", "warning"),
)


def presentation(queue: int, periods: int, products: int, anomalies: int = 1) -> dict[str, tuple]:
    """Packs of the presentation tables, by the numbers of rows that a delivery is to have."""
    return {
        "executive_kpis": (Row("latest_period_present", "coalesce(latest_reporting_period, '') <> ''"), Row("single_open_source_anomaly", f"all_period_open_source_anomalies = {anomalies}")),
        "priority_review_queue": (Size("priority_queue_has_expected_rows", queue, queue), Row("priority_queue_reviews_complete", "review_disposition IS NOT NULL")),
        "executive_period_trend": (Size("period_trend_has_expected_periods", periods, periods),),
        "executive_product_snapshot": (Size("product_snapshot_has_expected_products", products, products),),
    }
