"""Small fixtures that pin the semantics."""

from __future__ import annotations

import random
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from veldspar import contracts
from veldspar.functions import semantics as S
from veldspar.functions.names import fold_name, folded
from veldspar.operators import context, governance, identity, profile, reconcile, review
from veldspar.plans import methodology, panel, rules
from veldspar.sources import files, xlsx


def test_percentiles_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.0, None, 5.0, 9.0)], "g int, v double")
    got = sorted((r.v or 99, r.p) for r in df.select("v", S.pct_rank_avg("v", "g").alias("p")).collect())
    assert got == [(1.0, 0.2), (2.0, 0.5), (2.0, 0.5), (5.0, 0.8), (9.0, 1.0), (99, None)]
    q = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 16, 33)], "x double").select(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first().q
    assert q == [2.5, 6.0, 14.0]


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("5d",), ("nan",), ("Infinity",), ("1.5",), (None,), ("-2e3",)], "t string")
    assert [r[0] for r in df.select(S.try_number(F.col("t"))).collect()] == [None, None, None, 1.5, None, -2000.0]
    d = spark.createDataFrame([("16 Dec 75",), ("16 Dec 21",), ("x",)], "t string").select(S.day_month_year2(F.col("t"))).collect()
    assert [r[0] for r in d] == [date(1975, 12, 16), date(2021, 12, 16), None]
    w = spark.createDataFrame([("01-01-2021 to 30-06-2021",), ("2021-07-01 to 2021-12-31",), ("x",)], "w string")
    assert [tuple(r) for r in w.select(*S.window_bounds(F.col("w"))).collect()] == [(date(2021, 1, 1), date(2021, 6, 30)), (date(2021, 7, 1), date(2021, 12, 31)), (None, None)]
    p = spark.createDataFrame([("2021-H2", "2023-H1")], "a string, b string").select(S.periods_between(F.col("a"), F.col("b"))).first()[0]
    assert p == ["2021-H2", "2022-H1", "2022-H2", "2023-H1"]
    n = spark.createDataFrame([("  ﬁrm  ẞ A ",)], "n string").select(fold_name("n")).first()[0]
    assert n == "firm ss a"


def test_names_fold_alike_on_both_paths(spark):
    rng = random.Random(6)
    letters = "aAzZ09 \t\n\x0b\x0c\x1c\x1f\x85\u00a0\u2003éÉßẞﬁÅÅİıΣς①½"
    odd = ["".join(rng.choice(letters[: rng.choice([9, 14, len(letters)])]) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(odd)], "i long, n string")
    want = {r.i: r.f for r in df.select("i", fold_name("n").alias("f")).collect()}
    got = {r.i: r.f for r in folded(df, "n", "f").collect()}
    assert got == want


def test_guarded_reader(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t"), ["id"]).count() == 3
    with pytest.raises(contracts.ContractError, match="input is missing"):
        files.read_table(spark, str(tmp_path / "none"))
    with pytest.raises(contracts.ContractError, match="no columns"):
        files.read_table(spark, str(tmp_path / "t"), ["id", "x"])


def test_cell_values(spark):
    cases = {" ": (None, "missing"), None: (None, "missing"), "#N/A": (None, "invalid"), "1,234": (1234.0, "valid"), "12%": (0.12, "valid"), "n/a": (None, "missing_marker"), "true": (None, "invalid"), "abc": (None, "invalid")}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.metric_value(F.col("t")).alias("m")).collect()
    assert {r.t: (r.m.value, r.m.status) for r in got} == cases


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (2, "q"), (2, "r")], "k int, b string")
    assert contracts.checked_join(a, b.filter("k = 1"), ["k"], "left", "m:1").count() == 2
    for left, right, v in ((a, b.filter("k = 1"), "1:1"), (a, b, "m:1"), (a, b, "1:m")):
        with pytest.raises(Exception, match="not unique"):
            contracts.checked_join(left, right, ["k"], "inner", v).count()
    with pytest.raises(contracts.ContractError):
        contracts.assert_unique(b, ["k"])


def _features(spark, percentiles, shares=(0.5, 0.4)):
    rows = [("F", f"2025-H{i + 1}", f"w{i}", "P", date(2025, 1 + 6 * i, 1), date(2025, 6 * (i + 1), 28), 10.0, p, *shares, 1.0, 1.0, 0.5) for i, p in enumerate(percentiles)]
    return spark.createDataFrame(rows, "firm_key string, reporting_period string, source_reporting_period string, product_group string, observation_start date, observation_end date, complaints_opened_count double, complaints_upheld_pct_peer_percentile double, closed_within_3_days_pct double, closed_after_3_days_within_8_weeks_pct double, context_provision_rate double, context_intermediation_rate double, complaints_upheld_pct double")


def _method(**more):
    return methodology.validated({"methodology_id": "m", "methodology_status": "s", "minimum_peer_size": 1, "minimum_eligible_rules_for_classification": 1, "maximum_persistence_bonus": 2, "priority_bands": [{"minimum_score": 6, "label": "priority_review"}, {"minimum_score": 3, "label": "review"}, {"minimum_score": 0, "label": "none"}], "rules": [{"rule_id": "R", "label": "r", "category": "c", "points": 3, "peer_count_feature": "complaints_upheld_pct_peer_count", "conditions": [{"feature": "complaints_upheld_pct_peer_percentile", "operator": ">=", "threshold": 0.9}]}]} | more)


def test_rule_engine(spark):
    get = lambda f, m: [tuple(r) for r in rules.summary(f, m).orderBy("reporting_period").select("triggered_rule_count", "persistent_rule_count", "warning_score", "priority_band", "uncapped_base_warning_score", "point_cap_reduction").collect()]
    assert get(_features(spark, [1.0, 1.0]), _method()) == [(1, 0, 3, "review", 3, 0), (1, 1, 4, "review", 3, 0)]
    assert get(_features(spark, [None]), _method()) == [(0, 0, 0, "insufficient_data", 0, 0)]
    assert get(_features(spark, [float("nan")]), _method()) == [(0, 0, 0, "insufficient_data", 0, 0)]
    assert get(_features(spark, [1.0, 1.0]), _method(family_point_caps={"c": 2})) == [(1, 0, 2, "none", 3, 1), (1, 1, 3, "review", 3, 1)]
    assert rules.prepare(_features(spark, [1.0], (0.8, 0.4))).first().closed_over_8_weeks_pct is None
    with pytest.raises(contracts.ContractError):
        _method(priority_bands=[{"minimum_score": 2, "label": "x"}])


def test_scenarios():
    base = methodology.standard()
    s = dict(methodology.scenarios(base))
    assert len(s) == 15 and s["baseline"] == base == methodology.standard()
    assert s["peer_high_95"]["rules"][0]["conditions"][0]["threshold"] == 0.95
    assert s["priority_lower"]["priority_bands"][0]["minimum_score"] == 6 and s["priority_upper"]["priority_bands"][0]["minimum_score"] == 10
    assert dict(methodology.scenarios(methodology.standard(False)))["priority_lower"]["priority_bands"][0]["minimum_score"] == 5


def test_trends(spark):
    p = spark.createDataFrame([("F", "2025-H1", "2025-01-01 to 2025-06-30", "P", 10.0, 0.2), ("F", "2025-H2", "2025-07-01 to 2025-12-31", "P", 15.0, 0.3), ("G", "2025-H1", "x", "P", 0.0, None), ("G", "2025-H2", "y", "P", 5.0, None)], "firm_key string, reporting_period string, source_reporting_period string, product_group string, complaints_opened_count double, complaints_upheld_pct double")
    got = {(r.firm_key, r.reporting_period): (r.change_complaints_opened_count, r.pct_change_complaints_opened_count) for r in panel.add_trends(p, ["complaints_opened_count"]).collect()}
    assert got == {("F", "2025-H1"): (None, None), ("F", "2025-H2"): (5.0, 0.5), ("G", "2025-H1"): (None, None), ("G", "2025-H2"): (5.0, None)}


def test_pivot_refuses_collisions(spark):
    f = spark.createDataFrame([("F", "p", "s", "P", "opened", "complaints_opened", "count", 1.0, True, True)] * 2, "firm_key string, reporting_period string, source_reporting_period string, product_group string, canonical_sheet string, metric_name string, measurement_unit string, metric_value double, is_analysis_ready_value boolean, is_product_level boolean")
    with pytest.raises(contracts.ContractError):
        panel.pivot_facts(f)


def test_rates_and_series(spark):
    ch = spark.createDataFrame([("16 Dec 21", 0.25), ("05 Aug 21", 0.1), ("19 Mar 20", 0.1)], "d string, rate double").select(S.day_month_year2(F.col("d")).alias("effective_date"), "rate")
    per = spark.createDataFrame([("2021-H1",), ("2021-H2",)], "reporting_period string").select("reporting_period", S.period_start(F.col("reporting_period")).alias("period_start"), S.period_end(F.col("reporting_period")).alias("period_end"))
    got = [(r.start_rate, r.end_rate, r.rate_decision_count) for r in context.rate_context(ch, per).orderBy("reporting_period").collect()]
    assert got == [(0.1, 0.1, 0), (0.1, 0.25, 2)]
    s = context.wide_series(spark.createDataFrame([("2025 JAN", "3.0", "x"), ("2025 JUN", "4.0", "1")], "Title string, CPI string, Other string"), "Title", {"cpi": "CPI", "other": "Other"})
    r = context.series_half_year(s).filter("indicator_name = 'cpi'").first()
    assert (r.period_mean, r.period_end_value, r.within_period_change, r.month_count) == (3.5, 4.0, 1.0, 2)


def test_identity(spark):
    low = F.lower
    aliases = spark.createDataFrame([("H1", "Acme Ltd", "1.0", ""), ("H1", "Beta", "2", ""), ("H2", "Beta", "3", "")], "reporting_period string, firm_name string, frn string, trading_name string")
    seen = spark.createDataFrame([("H2", "ACME LTD"), ("H1", "beta"), ("H1", "Gamma"), ("H1", "Acme Limited"), ("H2", "Acme Limited")], "reporting_period string, firm_name string")
    walk = identity.crosswalk(seen, aliases, low)
    got = {(r.reporting_period, r.firm_name): (r.match_status, r.match_method, r.resolved_frn) for r in walk.collect()}
    assert got[("H2", "ACME LTD")] == ("matched", "exact_name_global_unique", "1") and got[("H1", "beta")][0] == "ambiguous" and got[("H1", "Gamma")][0] == "unmatched"
    sug = identity.suggest(seen.filter("firm_name = 'Acme Limited'"), aliases, fold_name)
    top = sug.filter("suggestion_rank = 1").collect()
    assert len(top) == 2 and all(r.candidate_name == "Acme Ltd" and r.exact_comparison_key for r in top)
    q = identity.review_queue(sug).collect()
    assert len(q) == 1 and q[0].priority_tier == "A" and q[0].affected_period_count == 2
    ok = sug.filter("suggestion_rank = 1 AND reporting_period = 'H1'").select("suggestion_id", F.lit("approved").alias("decision"), F.lit("me").alias("reviewer"), F.lit("2025-01-01").alias("reviewed_at"), F.lit("").alias("reviewer_comment"))
    new = identity.apply_decisions(sug, ok, walk)
    assert new.count() == walk.count() and new.filter("match_method = 'manually_approved_name_variant'").count() == 1
    both = sug.filter("reporting_period = 'H1'").select("suggestion_id", F.lit("approved").alias("decision"), F.lit("me").alias("reviewer"), F.lit("2025-01-01").alias("reviewed_at"), F.lit("").alias("reviewer_comment"))
    with pytest.raises(contracts.ContractError, match="More than one"):
        identity.apply_decisions(sug, both, walk)


def test_reconciliation(spark):
    rows = [(k, g, v, s, "count") for k, parts in {1: [("a", 5.0, "valid"), ("b", 7.0, "valid"), ("grand_total", 12.0, "valid")], 2: [("a", 5.0, "valid"), ("b", 7.0, "valid"), ("grand_total", 13.0, "valid")], 3: [("a", None, "missing"), ("grand_total", 5.0, "valid")]}.items() for g, v, s in parts]
    got = reconcile.totals(spark.createDataFrame(rows, "k int, product_group string, metric_value double, value_status string, measurement_unit string"), ["k"]).orderBy("k").collect()
    assert [(r.reconciliation_status, r.difference) for r in got] == [("matched", 0.0), ("mismatch", 1.0), ("not_comparable", None)]


def test_profile_and_gate(spark):
    marks = spark.createDataFrame([(x,) for x in (" ", "-", "*", "N/A", "#VALUE!", "5", None)], "x string").select(profile.text_marker(F.col("x"))).collect()
    assert [r[0] for r in marks] == ["blank", "missing_marker", "suppressed", "not_applicable", "excel_error", None, None]
    items = profile.review_items(spark.createDataFrame([("c", "s", "i", True)], "category string, scope string, issue string, blocks boolean"))
    none = items.limit(0).select("review_item_id", F.lit("x").alias("decision"))
    assert profile.gate(items, none).first().review_status == "awaiting_manual_review"
    assert profile.gate(items, items.select("review_item_id", F.lit("approve").alias("decision"))).first().extraction_authorised


def test_governance(spark):
    cols = "action_id string, status string, approval_status string, approved_by string, approved_at string, completed_at string"
    good = spark.createDataFrame([("a", "completed", "approved", "me", "2025-01-01", "2025-01-02")], cols)
    assert governance.load_register(good).count() == 1
    assert governance.release_gate(good, "approved").first().release_ready and not governance.release_gate(good, "pending").first().release_ready
    for bad in (("b", "completed", "approved", "", "2025-01-01", "2025-01-02"), ("b", "completed", "approved", "me", "x", ""), ("a", "in_progress", "pending_business_review", "", "", "")):
        with pytest.raises(contracts.ContractError):
            governance.load_register(good.union(spark.createDataFrame([bad], cols)))
    c = governance.coverage(spark.createDataFrame([("a",), ("a",), ("c",)], "reporting_period string"), ["a", "b"])
    assert {tuple(r) for r in c.collect()} == {("a", "repeated"), ("b", "missing"), ("c", "unexpected")}


def test_decisions_cover_the_sample(spark):
    keys = ["k"]
    sample = spark.createDataFrame([("a",), ("b",)], "k string")
    made = lambda ks: spark.createDataFrame([(k, "likely_false_positive", "me", "2025-01-01", "") for k in ks], "k string, review_outcome string, reviewer string, reviewed_at string, review_comment string")
    assert review.merge_decisions(sample, made("ab"), keys).count() == 2
    with pytest.raises(contracts.ContractError, match="exactly"):
        review.merge_decisions(sample, made("a"), keys)


def _workbook(path, cells):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{r}">' + "".join(cs) + "</row>" for r, cs in cells.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Opened" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData><mergeCells count='1'><mergeCell ref='A1:C1'/></mergeCells></worksheet>")


def test_workbooks(spark, tmp_path):
    text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    num = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>'
    _workbook(tmp_path / "data 2025_H1.xlsx", {1: [text("A1", "Title")], 3: [text("A3", "Firm Name"), text("B3", "Home finance"), text("C3", "Grand Total")], 4: [text("A4", "Acme"), num("B4", 12), num("C4", 12)], 5: [text("A5", "Total"), num("B5", 12), '<c r="C5"><f>B5</f></c>']})
    (tmp_path / "broken 2025-H2.xlsx").write_bytes(b"no zip")
    df = xlsx.cells(spark, str(tmp_path)).cache()
    assert df.filter("error IS NOT NULL").count() == 1
    inv = xlsx.inventory(df).first()
    assert (inv.last_row, inv.last_column, inv.formulas, inv.formulas_without_value, inv.merged_ranges) == (5, 3, 1, 1, 1)
    ranked = profile.header_candidates(df.filter("error IS NULL"), ["workbook", "sheet"], ["firm name", "grand total"])
    head = ranked.filter("candidate_rank = 1").select("workbook", "sheet", F.col("row").alias("header_row"))
    assert head.first().header_row == 3
    long = xlsx.wide_to_long(df, head, ["Firm Name"])
    assert sorted((r.raw_header, r.raw_value, r.source_row) for r in long.collect()) == [("Grand Total", "12", 4), ("Home finance", "12", 4)]
    assert df.select(xlsx.reporting_period(F.col("workbook"))).distinct().count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    files.write_template(df, str(tmp_path / "t"))
    files.write_template(df.filter("false"), str(tmp_path / "t"))
    assert files.read_csv(spark, str(tmp_path / "t"), "k string, n int").count() == 1
    assert files.markdown(df).endswith("| a | 1 |") and files.fingerprints(spark, str(tmp_path / "t"), "*.csv").count() >= 1
    bad = contracts.issues(df, {"positive": F.col("n") > 5})
    with pytest.raises(contracts.ContractError):
        files.publish({"x": df}, bad, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/x")).count() == 1


def test_markdown_has_every_row(spark):
    df = spark.range(120).coalesce(1)
    assert len(files.markdown(df).split("\n")) == 122
    assert files.markdown(df, 50).endswith("| 49 |\n\n70 more rows")
