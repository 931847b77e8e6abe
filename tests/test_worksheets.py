"""Worksheet operators on small grids: renames, structural rows, bounds, labels, registry, aliases, failing workbooks."""

from __future__ import annotations

import itertools
import json
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veldspar.contracts import ContractError
from veldspar.operators import extract, governance, identity, marts, renames, shortlist, worksheets as X

COLUMNS = "reporting_period string, canonical_sheet string, normalised_column string, column string, column_position int, storage_dtype string, semantic_type string, number_format_class string"
SHEETS = "reporting_period string, canonical_sheet string, sheet string, header_row int"


def _grid(spark, rows, workbook="b", sheet="s"):
    cells = [(workbook, sheet, r, c, "numeric" if isinstance(v, (int, float)) else "text", None if v is None else str(v)) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    return spark.createDataFrame(cells, "workbook string, sheet string, row int, col int, kind string, value string")


def _likeness(a, b):
    return 0.7 * SequenceMatcher(None, a[0], b[0]).ratio() + 0.2 * (a[1] == b[1]) + 0.1 * (a[2] == b[2])


def _greedy(removed, added):
    """(old, new, confidence), the best pair first, each column once; ties by name, last first."""
    left = {(_likeness(a, b), a[0], b[0]) for a, b in itertools.product(removed, added)}
    out = []
    while left and max(left)[0] >= 0.72:
        best = max(left)
        out.append((best[1], best[2], best[0]))
        left = {p for p in left if p[1] != best[1] and p[2] != best[2]}
    return out


def _side(spark, sheets):
    return spark.createDataFrame([(key, *c) for key, columns in sheets.items() for c in columns], "sheet string, name string, position int, kind string")


def _pairs(spark, removed, added):
    got = renames.paired(_side(spark, removed), _side(spark, added), ["sheet"]).collect()
    return {key: sorted((r.old, r.new, r.confidence) for r in got if r.sheet == key) for key in removed}


def test_rename_pairs_are_greedy_and_one_to_one(spark):
    removed = [("firm group", 2, "text"), ("total opened", 3, "numeric"), ("old thing", 9, "text")]
    added = [("group", 2, "text"), ("totals opened", 3, "numeric"), ("total opened count", 4, "numeric"), ("zz", 1, "date")]
    got = _pairs(spark, {"a": removed, "b": [], "c": removed}, {"a": added, "b": added, "c": []})
    assert got == {"a": sorted(_greedy(removed, added)), "b": [], "c": []}
    assert [p[:2] for p in got["a"]] == [("firm group", "group"), ("total opened", "totals opened")]


def test_rename_pairs_of_random_columns_are_brute_force(spark):
    """Names that are near each other in many ways, with ties, over several sheets at once."""
    rng = random.Random(11)
    words = ["opened", "closed", "upheld", "rate", "total", "pct", "aaaa", "aa", "b", "ab", "ba", "é", "x" * 230]

    def name():
        n = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
        at = rng.randrange(len(n) + 1)
        return n[:at] + rng.choice(["", "", "s", "z", " ", "aa"]) + n[at + rng.choice([0, 0, 1]) :]

    def side():
        return [(n, rng.randrange(12), rng.choice(["text", "numeric", "date"])) for n in sorted({name() for _ in range(50)}) if n]

    removed, added = {}, {}
    for key in "abcdef":
        removed[key] = side()
        known = {n for n, _, _ in removed[key]}
        added[key] = [c for c in side() if c[0] not in known]  # a name on both sides is a column that stayed
    got = _pairs(spark, removed, added)
    assert got == {key: sorted(_greedy(removed[key], added[key])) for key in removed}
    assert sum(map(len, got.values())) > 30


def test_like_names_share_bigrams():
    """The bound that the join on bigrams rests on."""
    rng = random.Random(2)
    for _ in range(20_000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30)))
        b = list(a)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "c", "dd"])
        b = "".join(b)
        if SequenceMatcher(None, a, b).ratio() >= renames.ALIKE:
            grams = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
            assert (grams(a) & grams(b)).total() >= renames.SHARED * (len(a) + len(b)) - 1 - 1e-9


def test_schema_renames_query_is_brute_force(spark, sf):
    from veldspar.queries import worksheets as Q

    schema = {}
    for r in Q.moving_schema(spark, sf).collect():
        schema.setdefault(r.reporting_period, {}).setdefault(r.canonical_sheet, {})[r.normalised_column] = (r.normalised_column, r.column_position, r.semantic_type)
    want = []
    periods = sorted(schema)
    for old, new in zip(periods, periods[1:]):
        for sheet in schema[old].keys() & schema[new].keys():
            a, b = schema[old][sheet], schema[new][sheet]
            lost, gained = [a[n] for n in a if n not in b], [b[n] for n in b if n not in a]
            pairs = _greedy(lost, gained)
            title = lambda n: " ".join(w.capitalize() for w in n.split(" "))
            want += [(old, new, sheet, "possible_column_renamed", title(x), title(y), round(c, 4)) for x, y, c in pairs]
            want += [(old, new, sheet, "column_removed", title(n), None, None) for n, _, _ in lost if n not in {p[0] for p in pairs}]
            want += [(old, new, sheet, "column_added", None, title(n), None) for n, _, _ in gained if n not in {p[1] for p in pairs}]
    got = [(r.previous_period, r.current_period, r.canonical_sheet, r.change_type, r.previous_column, r.current_column, r.confidence) for r in Q.schema_renames(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[3] == "possible_column_renamed" for w in want) >= 50


def test_schema_changes(spark):
    c = lambda p, s, n, at, kind="text", fmt="general": (p, s, n, n.title(), at, "object", kind, fmt)
    columns = [c("2021-H1", "opened", "firm name", 1), c("2021-H1", "opened", "firm group", 2), c("2021-H1", "opened", "gone", 3), c("2021-H1", "notes", "a", 1)]
    columns += [c("2021-H2", "opened", "firm name", 1, "identifier", "number"), c("2021-H2", "opened", "group", 2), c("2021-H2", "opened", "entirely new", 7), c("2022-H1", "opened", "firm name", 1, "identifier", "number")]
    sheets = [("2021-H1", "opened", "Opened", 3), ("2021-H1", "notes", "Notes", 1), ("2021-H2", "opened", "Opened!", 4), ("2022-H1", "opened", "Opened", 4)]
    got = X.schema_changes(spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(sheets, SHEETS)).collect()
    first = sorted((r.change_type, r.previous_value, r.current_value, r.review_status) for r in got if r.previous_period == "2021-H1")
    assert first == [
        ("column_added", None, "Entirely New", "manual_review"), ("column_removed", "Gone", None, "manual_review"), ("header_position_changed", "3", "4", "manual_review"), ("number_format_changed", "general", "number", "manual_review"),
        ("possible_column_renamed", "Firm Group", "Group", "manual_review"), ("semantic_type_changed", "text", "identifier", "manual_review"), ("sheet_removed", "Notes", None, "manual_review"),
    ]
    assert sorted((r.change_type, r.previous_value) for r in got if r.previous_period == "2021-H2") == [("column_removed", "Entirely New"), ("column_removed", "Group")]


def test_bounds_and_special_rows(spark):
    cells = _grid(spark, [["t", None, " "], [None, "", None], ["Grand  Total", 5, None], [" ", "Subtotal", 3], ["Totals", 1, None], ["x", "total", None], [None, None, " "]])
    declared = spark.createDataFrame([("b", "s", 9, 4), ("b", "none", 3, 2)], "workbook string, sheet string, declared_rows int, declared_columns int")
    found = X.bounds(cells, declared)
    assert {r.sheet: tuple(r)[2:] for r in found.collect()} == {"s": (6, 3, 4, 1), "none": (0, 0, 3, 0)}
    assert X.trimmed(cells, found).agg(F.max("row")).first()[0] == 6
    assert [(r.row, r.label) for r in X.special_rows(cells.withColumn("canonical_sheet", F.lit("closed"))).orderBy("row").collect()] == [(3, "grand total"), (4, "subtotal")]
    assert X.special_rows(cells.withColumn("canonical_sheet", F.lit("trading_names"))).count() == 0


def test_value_profile(spark):
    cells = _grid(spark, [[10, 1], [0, "2"], [-2, "unexpected"], [None, None], [" ", None], ["-", None], ["*", None], ["N/A", None], ["#VALUE!", None]])
    columns = spark.createDataFrame([("b", "s", 1, "A", "number"), ("b", "s", 2, "B", "general")], "workbook string, sheet string, col int, column string, number_format_class string")
    p = {r.col: r for r in X.value_profile(cells, columns).collect()}
    a = p[1]
    assert a.semantic_type == "integer_like" and {a.null_count, a.whitespace_string_count, a.missing_marker_count, a.suppressed_marker_count, a.not_applicable_marker_count, a.excel_error_count, a.zero_count, a.negative_count} == {1}
    assert (a.minimum_numeric_value, a.maximum_numeric_value) == (-2.0, 10.0)
    assert (p[2].semantic_type, p[2].numeric_parse_success_percent, p[2].non_numeric_example) == ("mixed", 66.6667, "unexpected")


def test_labels_and_notes(spark):
    rows = [("Home finance (b)",), ("Investments (per 1,000 policies sold) (A)",), ("Grand Total",), ("unnamed_4",), ("Other",)]
    d = spark.createDataFrame(rows, "column string").withColumn("sheet_type", F.lit("metric_wide_table"))
    got = {r.raw_product_label: (r.normalised_product_group, r.measurement_basis, r.footnote_marker, r.label_type) for r in X.product_labels(d).collect()}
    assert got["Home finance (b)"] == ("home finance", None, "b", "product_group") and got["Grand Total"][3] == "total" and got["unnamed_4"][3] == "unexpected_blank_header" and "Other" not in got
    assert got["Investments (per 1,000 policies sold) (A)"] == ("investments", "per 1,000 policies sold", "a", "product_group")
    notes = _grid(spark, [["Scope & use"], ["x" * 101], ["y" * 120], [None], ["Group", "Product"], ["Home finance", "Loan"], [" ", "Other loan"], ["(a) see note", None], ["Investments", "Fund"]])
    header = spark.createDataFrame([("b", "s", 5)], "workbook string, sheet string, header_row int")
    assert [(r.definition_key, r.definition_type) for r in X.definitions(notes, header).orderBy("source_row").collect()] == [("scope_use", "heading"), ("scope_use__1", "narrative"), ("scope_use__2", "narrative")]
    services = X.product_services(notes, header).orderBy("source_row").collect()
    assert [(r.inherited_product_group, r.raw_product_service_name, r.group_was_inherited) for r in services] == [("home finance", "Loan", False), ("home finance", "Other loan", True), ("investments", "Fund", False)]


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("maps")
    (folder / "product_group_mappings.csv").write_text("raw_label,canonical_product_group\nHome finance,home_finance\nGrand Total,grand_total\n")
    (folder / "sheet_mappings.csv").write_text("canonical_sheet,output_entity,metric_name,measurement_unit\nopened,complaint_metrics,complaints_opened,count\n")
    (folder / "reviewed_exceptions.csv").write_text("reporting_period,canonical_sheet,product_group,raw_value,value_status,value_reason\n2025-H2,opened,grand_total,#N/A,not_calculable,no_component_values\n")
    return extract.Registry.load(spark, str(folder))


def test_extraction(spark, registry):
    cells = _grid(spark, [["Title"], ["Firm Name", "Group", "Reporting period", "Home finance", "Grand Total"], ["A", "G", "P", 12, 12], ["B", None, "P", "-", "#N/A"], ["Total", None, None, 1, 2], [None, None, None, 5, 5], ["C"]])
    sheets = spark.createDataFrame([("b", "s", "2025-H2", "opened", 2)], "workbook string, sheet string, reporting_period string, canonical_sheet string, header_row int")
    body = extract.placed(cells, sheets)
    m = extract.metrics(body, registry)
    got = {(r.firm_name, r.product_group): (r.metric_value, r.value_status, r.raw_firm_group) for r in m.collect()}
    assert got == {("A", "home_finance"): (12.0, "valid", "G"), ("A", "grand_total"): (12.0, "valid", "G"), ("B", "home_finance"): (None, "missing_marker", ""), ("B", "grand_total"): (None, "not_calculable", ""), ("C", "home_finance"): (None, "missing", ""), ("C", "grand_total"): (None, "missing", "")}
    r = extract.reconciliation(body, m).first()
    assert (r.eligible_source_rows, r.expected_metric_records, r.extracted_metric_records, r.reconciliation_status) == (3, 6, 6, "matched")
    strange = extract.metrics(extract.placed(cells.withColumn("value", F.when(F.col("value") == "Home finance", "Martian").otherwise(F.col("value"))), sheets), registry)
    assert sorted(r.firm_name for r in strange.filter("rejected").collect()) == ["A", "B", "C"]


def test_registry_contract(spark, registry):
    twice = registry.products.unionByName(spark.createDataFrame([(" HOME  finance", "x")], "raw_label string, canonical_product_group string"))
    with pytest.raises(ContractError):
        extract.Registry(twice, registry.sheets, registry.exceptions)
    with pytest.raises(ContractError):
        extract.Registry(registry.products.drop("raw_label"), registry.sheets, registry.exceptions)


def test_aliases_and_joint_reporters(spark):
    sheets = spark.createDataFrame([("b", "s", "2025-H2", "trading_names", 1)], "workbook string, sheet string, reporting_period string, canonical_sheet string, header_row int")
    a = extract.aliases(extract.placed(_grid(spark, [["Firm name", "FRN", "Other trading names"], ["A", 1, "null"], ["B", 2, "0"], ["C", 3, None], ["D", 4, " Dee "], [None, 5, "x"]]), sheets))
    assert {(r.firm_name, r.frn, r.trading_name, r.value_status, r.value_reason) for r in a.collect()} == {("A", "1", "", "missing_marker", "source_null_literal"), ("B", "2", "", "missing_marker", "source_zero_placeholder"), ("C", "3", "", "missing", "blank_source_cell"), ("D", "4", "Dee", "valid", "")}
    j = extract.joint_reporters(extract.placed(_grid(spark, [["Firm Name", "Other firms included in return", "Reporting period"], ["A", "B", "P"], ["A", None, "P"]]), sheets))
    assert [(r.main_firm_name, r.included_firm_name, r.source_reporting_period) for r in j.collect()] == [("A", "B", "P")]


def test_taxonomy_of_one_layout(spark):
    t = X.taxonomy(_grid(spark, [["x"], ["y"], [None, "Bank", "Loans", "Car loan"], [None, None, None, "Home loan"], [None, None, "Cards", None]])).orderBy("source_row").collect()
    assert [(r.taxonomy_version, r.sector, r.product_group, r.product_type) for r in t] == [("new", "Bank", "Loans", "Car loan"), ("new", "Bank", "Loans", "Home loan"), ("new", "Bank", "Cards", "")]


def test_a_failed_workbook_fails_the_run_late(spark):
    cells = spark.createDataFrame([("good.xlsx", "1", None), ("bad.xlsx", None, "BadZipFile: x")], "workbook string, value string, error string")
    assert [r.workbook for r in extract.failures(cells).collect()] == ["bad.xlsx"]
    with pytest.raises(ContractError, match="bad.xlsx"):
        extract.fail_late(cells)
    extract.fail_late(cells.filter("error IS NULL"))


def test_suggestions_are_those_of_all_candidates(spark):
    """A short shortlist, so that it cuts: the same candidates as scoring every one of them."""
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "bank", "group", "x", "finance", "of"]
    name = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))
    aliases = sorted({(name(), str(i)) for i in range(60)} | {("zzz qqq", "900"), ("qqqq", "901")})
    firms = sorted({name() for _ in range(12)} | {"zz qq", "mmmm nn", "y"})
    a = spark.createDataFrame([("H1", n, f, "") for n, f in aliases], "reporting_period string, firm_name string, frn string, trading_name string")
    got = identity.suggest(spark.createDataFrame([("H1", f) for f in firms], "reporting_period string, firm_name string"), a, F.lower, shortlist=7).collect()

    def similarity(x, y):
        c = round(SequenceMatcher(None, x, y).ratio(), 6)
        t = round(SequenceMatcher(None, " ".join(sorted(x.split())), " ".join(sorted(y.split()))).ratio(), 6)
        return round(0.65 * SequenceMatcher(None, x, y).ratio() + 0.35 * SequenceMatcher(None, " ".join(sorted(x.split())), " ".join(sorted(y.split()))).ratio(), 6), c, t

    want = set()
    for f in firms:
        rough = lambda n: 0.8 * len(set(f.split()) & set(n.split())) / len(set(f.split()) | set(n.split())) + 0.2 * min(len(f), len(n)) / max(len(f), len(n), 1)  # noqa: E731, B023
        best = sorted(sorted(aliases, key=lambda x: (-rough(x[0]), x))[:7], key=lambda x: (-similarity(f, x[0])[0], -similarity(f, x[0])[1], x))
        want |= {(f, i, *x) for i, x in enumerate(best[:3], 1)}
    assert {(x.unmatched_firm_name, x.suggestion_rank, x.candidate_name, x.candidate_frn) for x in got} == want


@pytest.mark.parametrize(("seed", "most", "common"), [(1, 5, 6), (2, 12, 3), (3, 3, 0), (4, 4, 10**6)])
def test_shortlist_is_that_of_all_candidates(spark, seed, most, common):
    """Words that many candidates hold, copies, ties, lengths: what is left out is never among the best."""
    r = random.Random(seed)
    words = ["ltd"] * 6 + ["group"] * 3 + ["bank", "of", "alpha", "beta", "gamma", "delta", "zz", "longerword", "é"]
    name = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))
    cand = [(i, name(), f"n{r.randrange(40)}") for i in range(250)] + [(900, "", "n"), (901, "q" * 60, "n")]
    names = sorted({name() for _ in range(40)} | {"", "nothing alike", "y"})
    score = lambda a, b: 0.8 * (len(set(a.split(" ")) & set(b.split(" "))) / len(set(a.split(" ")) | set(b.split(" ")))) + 0.2 * (min(len(a), len(b)) / max(len(a), len(b), 1))
    got = shortlist.candidates_for(spark.createDataFrame([(n, n) for n in names], "name string, key string"), spark.createDataFrame(cand, "cid long, key string, label string"), ["label", "cid"], most, common).collect()
    found = {(x.name, x.cid) for x in got}
    assert len(found) == len(got)
    for n in names:
        best = sorted(cand, key=lambda c: (-score(n, c[1]), c[2], c[0]))[:most]  # noqa: B023
        assert {(n, c[0]) for c in best} <= found


def test_shortlist_of_a_common_word_makes_few_pairs(spark):
    """Every candidate and every name holds one word: not all are paired."""
    cand = spark.createDataFrame([(i, f"firm{i} ltd", f"{i:05d}") for i in range(3000)], "cid long, key string, label string")
    names = spark.createDataFrame([(f"other{i} ltd", f"other{i} ltd") for i in range(300)], "name string, key string")
    assert shortlist.candidates_for(names, cand, ["label"], 10, 100).count() <= 300 * 10 * 8 < 300 * 3000 / 30


def test_register_reports(spark):
    rows = [("A1", "First", "completed", "approved", "me", "2025-01-01", "2025-01-01", "o", "doc"), ("A2", "Second", "in_progress", "pending_business_review", "", "", "", "", "lost")]
    register = spark.createDataFrame(rows, "action_id string, action_title string, status string, approval_status string, approved_by string, approved_at string, completed_at string, owner string, evidence_reference string")
    evidence = spark.createDataFrame([("doc",)], "evidence_reference string")
    gate, agenda = governance.handoff(register, evidence, "A1", ["A2"])
    g = json.loads(gate)
    assert g["missing_evidence_references"] == ["A2:lost"] and not g["release_authorised"] and g["methodology_approved"] and "## A2: Second" in agenda
    assert json.loads(governance.handoff(register.filter("action_id = 'A1'"), evidence, "A1", ["A2"])[0])["release_authorised"]
    assert "- A2: Second" in governance.report(register, "A1") and "First" in governance.report(register, "A1")
    s = json.loads(governance.summary_json(governance.register_summary(register, "A1")))
    assert s["status_counts"]["completed"] == 1 and s["unassigned_open_action_count"] == 1
    assert json.loads(governance.snapshot({"rules": [1]}, "x.json")) == {"source": "x.json", "methodology": {"rules": [1]}}
    assert json.loads(governance.manifest("n", "no", {"d": [evidence, "table"]}, ["sum"]))["dashboards"][0]["sources"] == [{"evidence_reference": "string"}, "table"]


def test_case_decisions(spark):
    cases = spark.createDataFrame([("PCR-001", "F", "p"), ("PCR-002", "G", "p")], "case_id string, firm_key string, product_group string")
    ledger = marts.case_decisions(cases)
    assert marts.checked_case_decisions(ledger, cases).count() == 2
    with pytest.raises(ContractError, match="PCR-001"):
        marts.checked_case_decisions(ledger.withColumn("review_status", F.when(F.col("case_id") == "PCR-001", "completed").otherwise("not_started")), cases)
    with pytest.raises(ContractError, match="exactly"):
        marts.checked_case_decisions(ledger.filter("case_id = 'PCR-001'"), cases)
