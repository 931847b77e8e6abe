"""From a folder of workbooks to dashboards, each driver over what the one before it released."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests import workbooks
from veldspar import drivers
from veldspar.contracts import ContractError
from veldspar.operators import ledger
from veldspar.sources.releases import read, runs, versions

HEAD = ["Firm name", "FRN", "Firm group", "Reporting period", "Home finance", "Investments", "Grand total"]


def _book(path, year, half, firms):
    span = f"{year}-01-01 to {year}-06-30" if half == 1 else f"{year}-07-01 to {year}-12-31"
    lines = lambda f: [HEAD, *[[name, frn, "", span, *f(i)] for i, (name, frn) in enumerate(firms)]]
    count = lambda i: [10 + i + half, 20 * (i + 1), 10 + i + half + 20 * (i + 1)]
    share = lambda i: [round(0.1 + 0.03 * i, 2), round(0.9 - 0.05 * i, 2), 0.5]
    names = [["Firm name", "FRN", "Other trading names"], *[[name, frn, "null" if name == "Gamma" else f"{name} Online"] for name, frn in firms if name != "Delta Limited"], ["Delta Ltd", 103, "x"]]
    workbooks.write(path, {"Opened": lines(count), "Closed": lines(lambda i: [c + 30 for c in count(i)[:2]] + [count(i)[2] + 60]), "% Upheld": lines(share), "% closed within 3 days": lines(share), "Trading names": names})


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    at = tmp_path_factory.mktemp("world")
    (at / "in").mkdir()
    firms = [("Acme", 100), ("Beta", 101), ("Gamma", 102), ("Delta Limited", None)]
    for year, half in ((2024, 2), (2025, 1)):
        _book(at / f"in/firms {year}-H{half}.xlsx", year, half, firms)
    maps = at / "maps"
    maps.mkdir()
    (maps / "product_group_mappings.csv").write_text("raw_label,canonical_product_group\nHome finance,home_finance\nInvestments,investments\nGrand total,grand_total\n")
    roles = [("opened", "complaints_opened", "count"), ("closed", "complaints_closed", "count"), ("percentage_upheld", "complaints_upheld", "percentage"), ("percentage_within_3_days", "closed_within_3_days", "percentage")]
    (maps / "sheet_mappings.csv").write_text("canonical_sheet,output_entity,metric_name,measurement_unit\n" + "".join(f"{s},complaint_metrics,{m},{u}\n" for s, m, u in roles))
    (maps / "reviewed_exceptions.csv").write_text("reporting_period,canonical_sheet,product_group,raw_value,value_status,value_reason\n")
    return at


def _run(spark, world, command, **options):
    return drivers.main([command, *[x for k, v in options.items() for x in (f"--{k.replace('_', '-')}", str(v))]], spark)


def test_workbooks_to_dashboards(spark, world):
    at = lambda name: str(world / name)
    _run(spark, world, "profile", workbooks=at("in"), out=at("profile"), periods="2024-H2,2025-H1")
    with pytest.raises(ContractError, match="not authorised"):
        _run(spark, world, "extract", workbooks=at("in"), profiled=at("profile"), registry=at("maps"), out=at("extract"))
    pending = read(spark, at("profile"), "profiling_review_register").filter("blocks").select("review_item_id", *[F.lit(v).alias(c) for c, v in (("decision", "approved"), ("reviewer", "me"), ("reviewed_at", "2025-01-01"), ("reviewer_comment", ""))])
    ledger.Ledger(spark, at("decisions"), ledger.PROFILING).append(pending)
    _run(spark, world, "profile", workbooks=at("in"), out=at("profile"), decisions=at("decisions"))
    assert versions(spark, at("profile")) == [1, 2]

    got = _run(spark, world, "extract", workbooks=at("in"), profiled=at("profile"), registry=at("maps"), out=at("extract"))
    assert got.rows["complaint_metrics"] == 2 * 4 * 4 * 3 and got.rows["rejected_metrics"] == 0
    assert read(spark, at("extract"), "total_reconciliation").filter("reconciliation_status <> 'matched'").count() == 0

    _run(spark, world, "resolve", extracted=at("extract"), out=at("resolve"))
    walk = {(r.reporting_period, r.firm_name): r.match_status for r in read(spark, at("resolve"), "firm_identity_crosswalk").collect()}
    assert walk["2025-H1", "Acme"] == "matched" and walk["2025-H1", "Delta Limited"] == "unmatched"
    best = read(spark, at("resolve"), "firm_match_suggestions").filter("suggestion_rank = 1 AND candidate_name = 'Delta Ltd'")
    assert best.count() == 2
    decided = best.select("suggestion_id", *[F.lit(v).alias(c) for c, v in (("decision", "approved"), ("reviewer", "me"), ("reviewed_at", "2025-01-01"), ("reviewer_comment", ""))])
    ledger.Ledger(spark, at("matches"), drivers.MATCHES).append(decided)
    _run(spark, world, "apply_matches", extracted=at("extract"), resolved=at("resolve"), decisions=at("matches"), out=at("matched"))
    assert read(spark, at("matched"), "complaint_metrics_resolved").filter("resolved_frn = '103'").count() == 24

    star = _run(spark, world, "analyse", resolved=at("matched"), out=at("star"))
    assert star.rows["fact_firm_complaints"] == 96 and star.rows["dim_firm"] == 4 and star.rows["dim_product_group"] == 3
    panel = _run(spark, world, "features", analysed=at("star"), out=at("features"))
    assert panel.rows == {"complaint_features": 2 * 4 * 2, "peer_benchmarks": 4}
    wide = read(spark, at("features"), "complaint_features").filter("product_group = 'home_finance' AND reporting_period = '2025-H1'")
    assert sorted(r.complaints_opened_count_peer_percentile for r in wide.collect()) == [0.25, 0.5, 0.75, 1.0]
    assert {r.change_complaints_opened_count for r in wide.collect()} == {-1.0}

    warned = _run(spark, world, "warnings", featured=at("features"), out=at("warned"))
    assert warned.rows["warning_indicators"] == 16 * 9 and warned.rows["firm_period_warning_summary"] == 8
    checked = _run(spark, world, "validate", featured=at("features"), warned=at("warned"), out=at("validation"))
    assert checked.rows["band_stability"] == 16
    shown = _run(spark, world, "report", warned=at("warned"), analysed=at("star"), out=at("report"))
    assert shown.rows["dashboard_firm_product_period"] == 16 and shown.rows["executive_kpis"] == 1 and shown.rows["dashboard_firm_period"] == 8
    assert {r.display_firm_name for r in read(spark, at("report"), "dashboard_firm_period").collect()} == {"Acme", "Beta", "Gamma", "Delta Limited"}


def test_a_bad_workbook_fails_late(spark, world, tmp_path):
    for b in (world / "in").iterdir():
        (tmp_path / b.name).write_bytes(b.read_bytes())
    out = str(tmp_path / "profile")
    _run(spark, world, "profile", workbooks=tmp_path, out=out)
    (tmp_path / "bad 2025-H2.xlsx").write_bytes(b"no zip")
    with pytest.raises(ContractError, match="bad 2025-H2"):
        _run(spark, world, "profile", workbooks=tmp_path, out=out)
    assert versions(spark, out) == [1] and {r.status for r in runs(spark, out).collect()} == {"released", "rejected"}


def test_arguments():
    assert set(drivers.COMMANDS) == {"profile", "extract", "resolve", "apply_matches", "analyse", "features", "warnings", "validate", "report"}
    asked = drivers.parser().parse_args(["analyse", "--resolved", "a", "--out", "b"])
    assert (asked.resolved, asked.out, asked.decisions) == ("a", "b", "")
    with pytest.raises(SystemExit):
        drivers.parser().parse_args(["analyse", "--out", "b"])
