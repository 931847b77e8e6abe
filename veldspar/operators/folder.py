"""Profile of a folder of workbooks as a whole: every table of the profile from one reading of the workbooks.

Cells are cut once; all tables are aggregations of that table, whatever the number of workbooks and sheets: row shapes for headers,
and one pass over grouping sets (column; column and number format) for value profiles and format distributions. A
workbook that can't be read in full gives none of its cells; its error is a warning, an inventory row, and an issue that fails the
release of the tables at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.contracts import ContractError
from veldspar.functions.semantics import normalise_text
from veldspar.operators import governance, profile, worksheets as X
from veldspar.sources import files, xlsx
from veldspar.store import cut

SHEET = X.SHEET
#: Terms that headers of each type of sheet hold; the first type's serve for unknown ones.
_IDENTIFIERS = ("firm name", "firm group", "frn", "joint report", "joint reporting", "reporting period")
HEADER_TERMS = {
    "metric_wide_table": (*_IDENTIFIERS, *X.PRODUCT_LABELS, "grand total"),
    "consumer_credit_metric_table": (*_IDENTIFIERS, "reporting frequency", "semester", "grand total", "complaints received", "complaints closed", "complaints upheld", "percentage upheld"),
    "context_rate_table": (*_IDENTIFIERS, *X.PRODUCT_LABELS, "submission date"),
    "firm_alias_reference": ("firm name", "frn", "other trading names", "firm group"),
    "joint_reporter_reference": ("firm name", "reporting period", "other firms included in return"),
    "product_reference": ("product group", "product/service name"),
}
#: What a warning means for review: category, severity, whether it blocks extraction.
REVIEWED = {
    "FORMULA_WITHOUT_CACHED_VALUE": ("formula_values", "high", True),
    "EXCEL_ERROR_VALUES": ("excel_errors", "high", True),
    "MIXED_VALUE_TYPES": ("mixed_column", "high", True),
    "CANDIDATE_MISSING_MARKERS": ("missing_markers", "medium", True),
    "LOW_HEADER_CONFIDENCE": ("header_selection", "high", True),
    "HEADER_NOT_FIRST_ROW": ("header_selection", "low", False),
}
#: Schema changes that block extraction until they are interpreted.
BLOCKING_CHANGES = ("possible_column_renamed", "semantic_type_changed", "sheet_added", "sheet_removed")


def _said(df: DataFrame, code: str, severity: str, message, sheet: bool = True) -> DataFrame:
    return df.select("workbook", "reporting_period", (F.col("sheet") if sheet else F.lit(None).cast("string")).alias("sheet"), F.lit(code).alias("warning_code"), F.lit(severity).alias("severity"), message.alias("message"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_cells(found: DataFrame) -> dict[str, DataFrame]:
    """The tables of the profile from `found`, a cut table of cells as `xlsx.cells` gives them."""
    ok = xlsx.whole(found).filter("error IS NULL").drop("error")
    role = X.sheet_role(F.col("sheet"))
    ok = cut(ok.withColumns({"reporting_period": xlsx.reporting_period(F.col("workbook")), "canonical_sheet": role}).withColumn("sheet_type", X.role_type(F.col("canonical_sheet"))), "folder-cells")
    at = [*SHEET, "reporting_period", "canonical_sheet", "sheet_type"]
    grid, filled = ok.filter("kind <> 'merged'"), ~X.blank(F.col("value"))

    ranked = cut(profile.header_candidates(grid, [*at], HEADER_TERMS), "folder-headers")
    best = ranked.filter("candidate_rank = 1").select(*at, F.col("row").alias("header_row"), F.col("score").alias("header_score"), "runner_up_score", "score_margin", "header_confidence")
    shape = ok.groupBy(*at).agg(
        F.coalesce(F.max(F.when(filled, F.col("row"))), F.lit(0)).alias("last_value_row"), F.coalesce(F.max(F.when(filled, F.col("col"))), F.lit(0)).alias("last_value_column"), F.coalesce(F.min(F.when(filled, F.col("row"))) - 1, F.lit(0)).alias("empty_leading_rows"),
        F.count_if(F.col("kind") == "merged").alias("merged_cell_count"), F.count_if("formula").alias("formula_cell_count"), F.count_if(F.col("formula") & F.col("value").isNull()).alias("formula_without_cached_value_count"),
    )
    # No candidate at all: the first row is taken, with no confidence.
    sheets = shape.join(best, at, "left").withColumns({"header_confidence": F.coalesce("header_confidence", F.lit("none")), "header_row": F.coalesce("header_row", F.lit(1))})
    sheets = cut(sheets.withColumns({"requires_manual_review": F.col("header_confidence").isin("low", "none"), "data_rows": F.greatest(F.col("last_value_row") - F.col("header_row"), F.lit(0)), "data_columns": F.col("last_value_column")}), "folder-sheets")

    placed = cut(grid.join(sheets.select(*SHEET, "header_row", "last_value_row", "last_value_column", "data_rows"), SHEET).filter("row >= header_row AND row <= last_value_row"), "folder-body")
    raw = placed.filter("row = header_row").select(*SHEET, "col", F.trim("value").alias("raw_header"))
    every = sheets.filter("last_value_column > 0").select(*at, "data_rows", F.explode(F.sequence(F.lit(1), F.col("last_value_column"))).alias("col")).join(raw, [*SHEET, "col"], "left")
    named = every.withColumn("raw_header", F.when(X.blank(F.col("raw_header")), F.concat(F.lit("unnamed_"), F.col("col").cast("string"))).otherwise(F.col("raw_header")))
    named = profile.suffix_duplicates(named, SHEET, "raw_header", "col").withColumnRenamed("unique_name", "column")

    # One pass for values by column and for number formats.
    body = placed.filter("row > header_row")
    levels = cut(X.value_shapes(body), "folder-shapes")
    formats = cut(X.format_counts(levels), "folder-formats")
    of_column = formats.groupBy(*SHEET, "col").agg(F.array_sort(F.collect_set("number_format")).alias("number_formats"), F.max_by("number_format", F.struct("formatted_cell_count", "number_format")).alias("dominant_number_format"))
    known = named.join(of_column, [*SHEET, "col"], "left").withColumns({"number_formats": F.coalesce("number_formats", F.array(F.lit("General"))), "dominant_number_format": F.coalesce("dominant_number_format", F.lit("General"))})
    known = cut(known.withColumn("number_format_class", X.format_class(F.array_join("number_formats", " "))), "folder-known")
    columns = X.value_profile(None, known, levels.filter("by_column"))
    columns = columns.withColumns({"normalised_column": normalise_text(F.col("column")), "column_position": F.col("col"), "row_count": F.col("data_rows"), "missing_count": F.col("data_rows") - F.col("n_cells")})
    columns = cut(columns.withColumn("missing_percent", F.when(F.col("data_rows") > 0, F.round(F.col("missing_count") / F.col("data_rows") * 100, 4)).otherwise(0.0)), "folder-columns")

    head = sheets.filter("canonical_sheet = 'notes'").select(*SHEET, "header_row")
    notes = grid.filter("canonical_sheet = 'notes'").select(*SHEET, "row", "col", "value")
    taxonomy, definitions = X.product_services(notes, head), X.definitions(notes, head)
    labels = X.product_labels(columns.select(*at, "col", "column"))
    fields = columns.select("reporting_period", "canonical_sheet", "normalised_column", "column", F.col("column_position").cast("int").alias("column_position"), F.lit("object").alias("storage_dtype"), "semantic_type", "number_format_class").dropDuplicates(["reporting_period", "canonical_sheet", "normalised_column"])
    changes = cut(X.schema_changes(fields, sheets.select("reporting_period", "canonical_sheet", "sheet", "header_row").dropDuplicates(["reporting_period", "canonical_sheet"])), "folder-changes")

    text = lambda c: F.col(c).cast("string")
    twice = named.filter("column <> raw_header").groupBy(*at).agg(F.array_join(F.array_sort(F.collect_set("raw_header")), ", ").alias("names"))
    marks = F.col("missing_marker_count") + F.col("suppressed_marker_count") + F.col("not_applicable_marker_count")
    lost = found.filter("error IS NOT NULL").withColumn("reporting_period", xlsx.reporting_period(F.col("workbook")))
    warnings = _union([
        _said(sheets.filter("sheet_type = 'unclassified'"), "UNCLASSIFIED_SHEET", "warning", F.concat(F.lit("no structural profile for role "), "canonical_sheet")),
        _said(sheets.filter("header_confidence = 'none'"), "NO_HEADER_CANDIDATE", "warning", F.lit("no filled row for a header")),
        _said(twice, "DUPLICATE_HEADERS", "info", F.concat(F.lit("repeated headers: "), "names")),
        _said(sheets.filter("header_row > 1"), "HEADER_NOT_FIRST_ROW", "info", F.concat(F.lit("header row "), text("header_row"))),
        _said(sheets.filter("requires_manual_review"), "LOW_HEADER_CONFIDENCE", "warning", F.lit("weak anchors, or a small margin to the next candidate")),
        _said(sheets.filter("formula_without_cached_value_count > 0"), "FORMULA_WITHOUT_CACHED_VALUE", "warning", F.concat(text("formula_without_cached_value_count"), F.lit(" formulas without a cached value"))),
        _said(columns.filter("semantic_type = 'mixed'"), "MIXED_VALUE_TYPES", "warning", F.concat(F.lit("mixed values in "), "column")),
        _said(columns.filter("excel_error_count > 0"), "EXCEL_ERROR_VALUES", "warning", F.concat(text("excel_error_count"), F.lit(" errors in "), "column")),
        _said(columns.filter(marks > 0), "CANDIDATE_MISSING_MARKERS", "info", F.concat(marks.cast("string"), F.lit(" markers of absence in "), "column")),
        _said(lost, "WORKBOOK_FAILURE", "error", F.col("error")),
    ])
    return {
        "sheet_inventory": sheets, "column_profiles": columns, "header_detection_results": ranked, "cell_format_profiles": formats.join(known.select(*SHEET, "col", "column", "reporting_period"), [*SHEET, "col"]), "product_taxonomy_inventory": taxonomy,
        "reporting_definitions": definitions, "product_group_inventory": labels, "schema_comparison": changes, "profiling_warnings": cut(warnings, "folder-warnings"),
    }


def findings(tables: dict[str, DataFrame]) -> DataFrame:
    """What people have to review (category, scope, issue, severity, blocks), from warnings and schema changes."""
    spark = tables["profiling_warnings"].sparkSession
    rules = spark.createDataFrame([(code, *r) for code, r in REVIEWED.items()], "warning_code string, category string, review_severity string, blocks boolean")
    scope = F.concat_ws(" / ", F.when(F.col("reporting_period") != "", F.col("reporting_period")), "sheet")
    said = tables["profiling_warnings"].join(F.broadcast(rules), "warning_code").select("category", F.when(scope == "", "workbook").otherwise(scope).alias("scope"), F.col("message").alias("issue"), F.col("review_severity").alias("severity"), "blocks")
    counts = tables["schema_comparison"].filter(F.col("change_type").isin(*BLOCKING_CHANGES)).groupBy("change_type").count()
    changed = counts.select(F.lit("schema_changes").alias("category"), F.col("change_type").alias("scope"), F.concat(F.col("count").cast("string"), F.lit(" "), "change_type", F.lit(" records need interpretation")).alias("issue"), F.when(F.col("change_type") == "sheet_added", "medium").otherwise("high").alias("severity"), F.lit(True).alias("blocks"))
    return said.unionByName(changed).distinct()


def profile_folder(spark: SparkSession, folder: str, expected_periods: list[str] | None = None, decisions: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, issues) of all workbooks of a folder; `issues` has a row for each that could not be read.

    Periods that are missing, unexpected or there twice are an error before anything is read. `decisions` (review_item_id, decision).
    """
    books = files.fingerprints(spark, folder, "*.xls[xm]").withColumnRenamed("name", "workbook").withColumn("reporting_period", xlsx.reporting_period(F.col("workbook")))
    if expected_periods is not None and (bad := governance.coverage(books, expected_periods).orderBy("reporting_period").collect()):
        raise ContractError("; ".join(f"{r['reporting_period']}: {r['status']}" for r in bad))
    found = cut(xlsx.cells(spark, folder), "folder-found")
    tables = profile_cells(found)
    held = tables["sheet_inventory"].groupBy("workbook").agg(F.count("*").alias("sheet_count"), F.array_sort(F.collect_list("sheet")).alias("sheet_names"), F.sum("data_rows").alias("rows_extracted"))
    said = tables["profiling_warnings"].groupBy("workbook").agg(F.count("*").alias("warning_count"), F.max(F.col("warning_code") == "WORKBOOK_FAILURE").alias("failed"))
    inventory = books.join(held, "workbook", "left").join(said, "workbook", "left").na.fill(0, ["sheet_count", "rows_extracted", "warning_count"])
    inventory = inventory.withColumn("processing_status", F.when(F.coalesce("failed", F.lit(False)), "failed").otherwise("success")).drop("failed")
    items = cut(profile.review_items(findings(tables)), "folder-items")
    decided = items.select("review_item_id", F.lit(None).cast("string").alias("decision")).limit(0) if decisions is None else decisions
    tables |= {"workbook_inventory": inventory, "profiling_review_register": items.join(decided.select("review_item_id", "decision"), "review_item_id", "left"), "profiling_review_gate": profile.gate(items, decided)}
    failures = found.filter("error IS NOT NULL").groupBy("workbook").count().select(F.lit("error").alias("severity"), F.concat(F.lit("unreadable: "), "workbook").alias("rule"), F.col("count"))
    return tables, failures
