"""Extraction of worksheets under a mapping registry: metrics, rejected headers, aliases, joint reporters, reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.contracts import ContractError, assert_unique, require_columns
from veldspar.functions.semantics import metric_value, normalise_text, strip_qualifier
from veldspar.operators.worksheets import SHEET, alias_value, blank, context_basis, credit_measure, identifier_name
from veldspar.sources.files import read_csv

#: Names that are no firms.
NO_FIRM = ("total", "grand total", "include")
IDENTITY = ["firm_name", "frn", "raw_firm_group", "joint_reporting_flag", "source_reporting_period"]


@dataclass(frozen=True)
class Registry:
    """Mappings of product labels and sheet roles, and reviewed exceptions; small tables that are broadcast."""

    products: DataFrame  # raw_label, canonical_product_group
    sheets: DataFrame  # canonical_sheet, output_entity, metric_name, measurement_unit
    exceptions: DataFrame  # reporting_period, canonical_sheet, product_group, raw_value, value_status, value_reason

    #: Most rows of each table: people keep them by hand.
    LARGEST = 100_000

    def __post_init__(self):
        require_columns(self.products, ["raw_label", "canonical_product_group"])
        require_columns(self.sheets, ["canonical_sheet", "output_entity", "metric_name", "measurement_unit"])
        require_columns(self.exceptions, ["reporting_period", "canonical_sheet", "product_group", "raw_value", "value_status", "value_reason"])
        assert_unique(self.products.select(normalise_text(F.col("raw_label")).alias("label")), ["label"])
        assert_unique(self.sheets, ["canonical_sheet"])
        for t in (self.products, self.sheets, self.exceptions):
            if t.count() > self.LARGEST:
                raise ContractError(f"a mapping has more than {self.LARGEST} rows")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Registry:
        text = lambda cols: ", ".join(f"{c} string" for c in cols)
        return cls(
            read_csv(spark, f"{folder}/product_group_mappings.csv", text(["raw_label", "canonical_product_group"]), True),
            read_csv(spark, f"{folder}/sheet_mappings.csv", text(["canonical_sheet", "output_entity", "metric_name", "measurement_unit"]), True),
            read_csv(spark, f"{folder}/reviewed_exceptions.csv", text(["reporting_period", "canonical_sheet", "product_group", "raw_value", "value_status", "value_reason"]), True),
        )

    def labels(self) -> DataFrame:
        return F.broadcast(self.products.select(normalise_text(F.col("raw_label")).alias("label"), F.col("canonical_product_group").alias("product_group")))


def placed(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Cells below their header row with their header: `sheets` (workbook, sheet, reporting_period, canonical_sheet, header_row)."""
    at = cells.join(sheets, SHEET)
    heads = at.filter("row = header_row").select(*SHEET, "col", F.trim("value").alias("raw_header"))
    body = at.filter("row > header_row").join(heads, [*SHEET, "col"], "left")
    return body.withColumn("raw_header", F.when(blank(F.col("raw_header")), F.concat(F.lit("unnamed_"), F.col("col").cast("string"))).otherwise(F.col("raw_header")))


def identities(body: DataFrame) -> DataFrame:
    """One row for each source row with a firm: identifying cells by canonical name, absent ones empty."""
    named = body.withColumn("id", identifier_name(F.col("raw_header"))).filter("id IS NOT NULL")
    at = [*SHEET, "reporting_period", "canonical_sheet", "row"]
    wide = named.groupBy(*at).agg(*[F.coalesce(F.max(F.when(F.col("id") == i, F.trim("value"))), F.lit("")).alias(i) for i in IDENTITY])
    return wide.filter(~normalise_text(F.col("firm_name")).isin("", *NO_FIRM))


def metrics(body: DataFrame, registry: Registry, percentage_periods: tuple[str, ...] = ()) -> DataFrame:
    """Every metric cell with firm, measure, product, value and lineage; `rejected` marks cells under unmapped headers.

    A reviewed exception replaces the status of the cells it names. Blank and unnamed headers are no metrics.
    """
    at = [*SHEET, "reporting_period", "canonical_sheet"]
    heads = body.select(*at, "col", "raw_header").distinct().filter(identifier_name(F.col("raw_header")).isNull())
    credit = F.col("canonical_sheet") == "consumer_credit"
    label = normalise_text(strip_qualifier(F.col("raw_header")))
    m = credit_measure(F.col("raw_header"), F.col("reporting_period"), percentage_periods)
    heads = heads.withColumn("label", label).join(registry.labels(), "label", "left").join(F.broadcast(registry.sheets), "canonical_sheet", "left")
    heads = heads.select(
        *at, "col", "raw_header", F.when(credit, F.when(m["metric_name"] != "", "consumer_credit")).otherwise(F.col("product_group")).alias("product_group"), F.when(credit, m["metric_name"]).otherwise(F.col("metric_name")).alias("metric_name"),
        F.when(credit, m["measurement_unit"]).otherwise(F.col("measurement_unit")).alias("measurement_unit"), F.when(~credit & (F.col("measurement_unit") == "context_rate"), context_basis(F.col("raw_header"), F.col("canonical_sheet"))).otherwise("").alias("measurement_basis"),
        (credit & (m["metric_name"] == "")).alias("no_measure"),
    )
    heads = heads.filter(~F.col("no_measure") & (F.col("product_group").isNotNull() | ~(normalise_text(F.col("raw_header")).startswith("unnamed") | (normalise_text(F.col("raw_header")) == "include")))).drop("no_measure", "raw_header")
    # Cells of an absent value are no rows of the cell table: firms meet headers of their own sheet, as the worksheet's grid has them.
    grid = identities(body).join(heads, at)
    cells = grid.join(body.select(*SHEET, "row", "col", "raw_header", "value"), [*SHEET, "row", "col"], "left")
    v = metric_value(F.col("value"))
    out = cells.withColumn("v", v).select(
        "reporting_period", *IDENTITY, "canonical_sheet", "metric_name", "product_group", F.col("v.value").alias("metric_value"), "measurement_unit", "measurement_basis", F.col("v.status").alias("s"), F.col("v.reason").alias("r"), F.coalesce("value", F.lit("")).alias("raw_value"),
        F.col("workbook").alias("source_workbook"), F.col("sheet").alias("source_sheet"), F.col("row").alias("source_row"), F.col("col").alias("source_column"), F.col("product_group").isNull().alias("rejected"),
    )
    reviewed = F.broadcast(registry.exceptions)
    out = out.join(reviewed, ["reporting_period", "canonical_sheet", "product_group", "raw_value"], "left")
    return out.withColumns({"value_status": F.coalesce("value_status", "s"), "value_reason": F.coalesce("value_reason", "r")}).drop("s", "r")


def reconciliation(body: DataFrame, found: DataFrame) -> DataFrame:
    """Per sheet: firms times mapped headers against the metric rows made; `found` is what `metrics` gives."""
    at = [F.col("source_workbook").alias("workbook"), F.col("source_sheet").alias("sheet")]
    made = found.groupBy(*at).agg(F.count_if(~F.col("rejected")).alias("extracted_metric_records"), F.count_if("rejected").alias("rejected_records"), F.count_distinct(F.when(~F.col("rejected"), F.col("source_column"))).alias("mapped_metric_columns"))
    firms = identities(body).groupBy(*SHEET, "reporting_period", "canonical_sheet").agg(F.count("*").alias("eligible_source_rows"))
    j = firms.join(made, SHEET, "left").na.fill(0, ["extracted_metric_records", "rejected_records", "mapped_metric_columns"])
    expected = F.col("eligible_source_rows") * F.col("mapped_metric_columns")
    good = (expected == F.col("extracted_metric_records")) & (F.col("rejected_records") == 0)
    return j.withColumn("expected_metric_records", expected).withColumn("reconciliation_status", F.when(good, "matched").otherwise("mismatch"))


def aliases(body: DataFrame) -> DataFrame:
    """Trading names of firms, with literals for absence told apart."""
    named = body.filter(normalise_text(F.col("raw_header")).contains("trading name")).groupBy(*SHEET, "row").agg(F.min_by("value", "col").alias("value"))
    return identities(body).join(named, [*SHEET, "row"], "left").withColumn("a", alias_value(F.col("value"))).select(
        "reporting_period", "firm_name", "frn", "raw_firm_group", F.col("a.alias").alias("trading_name"), F.col("a.status").alias("value_status"), F.col("a.reason").alias("value_reason"), F.trim(F.coalesce("value", F.lit(""))).alias("raw_value"),
        F.col("workbook").alias("source_workbook"), F.col("sheet").alias("source_sheet"), F.col("row").alias("source_row"),
    )


def joint_reporters(body: DataFrame) -> DataFrame:
    """Firms that report for others."""
    head, cell = normalise_text(F.col("raw_header")), F.trim("value")
    g = body.groupBy(*SHEET, "reporting_period", "canonical_sheet", "row").agg(
        F.max(F.when(head == "firm name", cell)).alias("main_firm_name"), F.max(F.when(head.contains("other firms included"), cell)).alias("included_firm_name"), F.max(F.when(head == "reporting period", cell)).alias("source_reporting_period")
    )
    return g.filter(~blank(F.col("main_firm_name")) & ~blank(F.col("included_firm_name"))).na.fill("", ["source_reporting_period"])


def failures(cells: DataFrame) -> DataFrame:
    """Workbooks that could not be read, with their error: none of their rows is among the cells."""
    return cells.filter("error IS NOT NULL").select("workbook", "error")


def fail_late(cells: DataFrame) -> None:
    """To be called when all tables are written: an error that names every workbook that could not be read."""
    if bad := failures(cells).orderBy("workbook").collect():
        raise ContractError("; ".join(f"{r['workbook']}: {r['error']}" for r in bad))
