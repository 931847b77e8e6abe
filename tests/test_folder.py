"""The profile of a folder as a whole: tables, warnings, review items, and a workbook that fails."""

from __future__ import annotations

import pytest

from tests import workbooks
from veldspar.contracts import ContractError
from veldspar.operators import folder as P
from veldspar.sources import releases


def _sheet(*rows):
    return [["Title"], *[[None]] * 1, *rows]


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    at = tmp_path_factory.mktemp("folder")
    head = ["Firm name", "FRN", "Home finance", "Investments", "Grand total"]
    opened = _sheet(head, ["Acme", 100, 5, 0.5, 5.5], ["Beta", 101, 7, "n/a", 7], ["Gamma", 102, -1, "#N/A", "=C6"])
    styles = {("Opened", r, 4): 1 for r in (4, 5, 6)} | {("Opened", 6, 3): 2}
    notes = [["A heading"], ["A narrative that is much longer than a hundred characters, so that it is no heading but the text of a definition, told in full."], ["Product group", "Product/service name"], ["Home finance (a)", "Mortgage"], [None, "Equity release"]]
    workbooks.write(at / "firms 2025-H1.xlsx", {"Opened": opened, "Notes": notes}, formats=(0, 9, 164), styles=styles, merged={"Opened": ["A1:C1", "D1:E1"]})
    renamed = [["Title"], [None], ["Firm name", "FRN", "Home finances", "Investments", "Grand total"], ["Acme", 100, 5, 0.5, 5.5], ["Beta", 101, 7, 0.25, 7]]
    workbooks.write(at / "firms 2025-H2.xlsx", {"Opened": renamed, "Odd sheet": [["x", "x"], [1, 2]], "Empty": []}, formats=(0, 9), styles={("Opened", 4, 4): 1, ("Opened", 5, 4): 1})
    return at


@pytest.fixture(scope="module")
def profiled(spark, books):
    return P.profile_folder(spark, str(books), ["2025-H1", "2025-H2"])


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_sheets(profiled):
    tables, issues = profiled
    assert issues.count() == 0
    sheets = {(r.reporting_period, r.sheet): r for r in tables["sheet_inventory"].collect()}
    a = sheets["2025-H1", "Opened"]
    assert (a.canonical_sheet, a.sheet_type, a.header_row, a.header_confidence, a.last_value_row, a.last_value_column) == ("opened", "metric_wide_table", 3, "high", 6, 5)
    assert (a.merged_cell_count, a.formula_cell_count, a.formula_without_cached_value_count, a.data_rows, a.data_columns, a.empty_leading_rows) == (2, 1, 1, 3, 5, 0)
    assert sheets["2025-H1", "Notes"].header_row == 3 and sheets["2025-H2", "Odd sheet"].sheet_type == "unclassified"
    assert _rows(tables["workbook_inventory"], "workbook", "reporting_period", "processing_status", "sheet_count", "rows_extracted") == [("firms 2025-H1.xlsx", "2025-H1", "success", 2, 5), ("firms 2025-H2.xlsx", "2025-H2", "success", 2, 3)]


def test_columns_and_formats(profiled):
    tables, _ = profiled
    columns = {(r.reporting_period, r.sheet, r.column): r for r in tables["column_profiles"].collect()}
    assert columns["2025-H1", "Opened", "Firm name"].semantic_type == "identifier"
    home = columns["2025-H1", "Opened", "Home finance"]
    assert (home.semantic_type, home.row_count, home.negative_count, home.missing_count, home.minimum_numeric_value) == ("integer_like", 3, 1, 0, -1.0)
    share = columns["2025-H1", "Opened", "Investments"]
    assert (share.number_format_class, share.not_applicable_marker_count, share.excel_error_count) == ("percentage", 1, 1)
    assert columns["2025-H2", "Odd sheet", "x_2"].column_position == 2
    total = columns["2025-H1", "Opened", "Grand total"]
    assert (total.missing_count, total.missing_percent) == (1, 33.3333)
    formats = _rows(tables["cell_format_profiles"].filter("reporting_period = '2025-H1' AND column IN ('Home finance', 'Investments')"), "column", "number_format", "formatted_cell_count", "formatted_cell_percent")
    assert formats == [("Home finance", "General", 3, 100.0), ("Investments", "0%", 3, 100.0)]


def test_notes_labels_and_changes(profiled):
    tables, _ = profiled
    assert _rows(tables["product_taxonomy_inventory"], "inherited_product_group", "raw_product_service_name", "footnote_marker") == [("home finance", "Equity release", None), ("home finance", "Mortgage", "a")]
    assert _rows(tables["reporting_definitions"], "definition_key", "definition_type") == [("a_heading", "heading"), ("a_heading__1", "narrative")]
    assert ("home finance", "product_group") in _rows(tables["product_group_inventory"], "normalised_product_group", "label_type")
    changes = _rows(tables["schema_comparison"], "change_type", "previous_value", "current_value")
    assert ("possible_column_renamed", "Home finance", "Home finances") in changes and ("sheet_removed", "Notes", None) in changes and ("sheet_added", None, "Odd sheet") in changes


def test_warnings_and_gate(spark, books, profiled):
    tables, _ = profiled
    codes = {r.warning_code for r in tables["profiling_warnings"].collect()}
    assert {"UNCLASSIFIED_SHEET", "DUPLICATE_HEADERS", "HEADER_NOT_FIRST_ROW", "FORMULA_WITHOUT_CACHED_VALUE", "EXCEL_ERROR_VALUES", "CANDIDATE_MISSING_MARKERS"} <= codes
    gate, items = tables["profiling_review_gate"].first(), tables["profiling_review_register"]
    assert gate.review_status == "awaiting_manual_review" and gate.blocking_items == items.filter("blocks").count() > 3
    decided = items.select("review_item_id").selectExpr("review_item_id", "'approved' AS decision")
    again, _ = P.profile_folder(spark, str(books), decisions=decided)
    assert again["profiling_review_gate"].first().extraction_authorised


def test_periods_are_checked_first(spark, books):
    with pytest.raises(ContractError, match="2024-H2: missing; 2025-H2: unexpected"):
        P.profile_folder(spark, str(books), ["2024-H2", "2025-H1"])


def test_one_bad_workbook_fails_late_and_leaves_the_last_release(spark, books, tmp_path):
    out = str(tmp_path / "out")
    tables, issues = P.profile_folder(spark, str(books))
    releases.publish(spark, out, tables, known_issues=issues)
    good = releases.read(spark, out, "column_profiles").count()
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    for b in books.iterdir():
        (mixed / b.name).write_bytes(b.read_bytes())
    workbooks.write(mixed / "late 2026-H1.xlsx", {"Opened": [["Firm name", "FRN"], ["A", 1]], "Closed": [["x"]]}, broken=("Closed",))
    tables, issues = P.profile_folder(spark, str(mixed))
    assert tables["sheet_inventory"].filter("workbook LIKE 'late%'").count() == 0
    with pytest.raises(ContractError, match="late 2026-H1.xlsx"):
        releases.publish(spark, out, tables, known_issues=issues)
    assert releases.versions(spark, out) == [1] and releases.read(spark, out, "column_profiles").count() == good
    rejected = releases.runs(spark, out).filter("status = 'rejected'").first()
    told = spark.read.parquet(f"{out}/workbook_inventory/run={rejected.run}")
    assert _rows(told.filter("processing_status = 'failed'"), "workbook", "rows_extracted") == [("late 2026-H1.xlsx", 0)]
