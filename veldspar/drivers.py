"""Drivers: each reads what an earlier one released, and releases its own tables as a whole, or fails and leaves the last release.

    python -m veldspar.drivers profile --workbooks in/ --out work/profile --periods 2025-H1,2025-H2
    python -m veldspar.drivers extract --workbooks in/ --profiled work/profile --registry mappings/ --out work/extract
    python -m veldspar.drivers resolve --extracted work/extract --out work/resolve
    python -m veldspar.drivers analyse --resolved work/resolve --out work/star
    python -m veldspar.drivers features --analysed work/star --out work/features
    python -m veldspar.drivers warnings --featured work/features --out work/warnings
    python -m veldspar.drivers validate --featured work/features --warned work/warnings --out work/validation
    python -m veldspar.drivers report --warned work/warnings --analysed work/star --out work/report

Arguments are paths that Spark reads, of releases (see `veldspar.sources.releases`), ledgers or folders.
"""

from __future__ import annotations

import argparse
import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.contracts import ContractError, checked_join
from veldspar.functions.names import fold_name
from veldspar.functions.semantics import stable_key
from veldspar.operators import extract as E
from veldspar.operators import folder, identity, ledger, marts, packs, reconcile, review, star
from veldspar.plans import methodology as M
from veldspar.plans import panel, rules
from veldspar.sources import xlsx
from veldspar.sources.releases import Release, publish, read
from veldspar.store import cut, settled, text_of

METRIC_TYPES = ("metric_wide_table", "consumer_credit_metric_table", "context_rate_table")
_CELL = ["reporting_period", "firm_name", "canonical_sheet", "metric_name", "source_workbook", "source_sheet", "source_row"]


def profile(spark: SparkSession, workbooks: str, out: str, periods: str = "", decisions: str = "") -> Release:
    """Tables of the profile, the review register and its gate; workbooks that can't be read fail the release at the end."""
    decided = ledger.Ledger(spark, decisions, ledger.PROFILING).latest() if decisions else None
    tables, failures = folder.profile_folder(spark, workbooks, periods.split(",") if periods else None, decided)
    return publish(spark, out, tables, known_issues=failures)


def extract(spark: SparkSession, workbooks: str, profiled: str, registry: str, out: str, percentage_periods: str = "") -> Release:
    """Metric cells with lineage, rejected headers, trading names, joint reporters and reconciliations, once the profile's gate is open."""
    gate = read(spark, profiled, "profiling_review_gate").first()
    if not gate["extraction_authorised"]:
        raise ContractError(f"extraction is not authorised: {gate['review_status']}, {gate['pending_items']} pending")
    found = cut(xlsx.cells(spark, workbooks), "extract-found")
    sheets = read(spark, profiled, "sheet_inventory").select(*folder.SHEET, "reporting_period", "canonical_sheet", "sheet_type", "header_row")
    cells = xlsx.whole(found).filter("error IS NULL AND kind <> 'merged'").select(*folder.SHEET, "row", "col", "value")
    body_of = lambda *types: E.placed(cells, sheets.filter(F.col("sheet_type").isin(*types)).drop("sheet_type"))
    body = cut(body_of(*METRIC_TYPES), "extract-body")
    made = cut(E.metrics(body, E.Registry.load(spark, registry), tuple(p for p in percentage_periods.split(",") if p)), "extract-metrics")
    accepted = made.filter("NOT rejected").drop("rejected")
    tables = {
        "complaint_metrics": accepted, "rejected_metrics": made.filter("rejected"), "firm_aliases": E.aliases(body_of("firm_alias_reference")), "joint_reporters": E.joint_reporters(body_of("joint_reporter_reference")),
        "sheet_reconciliation": E.reconciliation(body, made), "total_reconciliation": reconcile.totals(accepted, _CELL),
    }
    failures = found.filter("error IS NOT NULL").groupBy("workbook").count().select(F.lit("error").alias("severity"), F.concat(F.lit("unreadable: "), "workbook").alias("rule"), "count")
    return publish(spark, out, tables, {"complaint_metrics": packs.METRICS, "sheet_reconciliation": packs.SHEET_RECONCILIATION, "total_reconciliation": packs.TOTAL_RECONCILIATION}, failures)


def resolve(spark: SparkSession, extracted: str, out: str) -> Release:
    """The identity crosswalk, metrics with resolved identifiers, ranked suggestions for unmatched names and their review queue."""
    metrics, aliases = read(spark, extracted, "complaint_metrics"), read(spark, extracted, "firm_aliases")
    walk = cut(identity.crosswalk(metrics, aliases, fold_name), "crosswalk")
    suggestions = cut(identity.suggest(walk.filter("match_status = 'unmatched'"), aliases, fold_name), "suggestions")
    return publish(spark, out, {"firm_identity_crosswalk": walk, "complaint_metrics_resolved": _resolved(metrics, walk), "firm_match_suggestions": suggestions, "firm_match_review_queue": identity.review_queue(suggestions)})


def _resolved(metrics: DataFrame, walk: DataFrame) -> DataFrame:
    return checked_join(metrics, walk.select("reporting_period", "firm_name", "resolved_frn", "match_status", "match_method"), ["reporting_period", "firm_name"], "left", "m:1")


#: Decisions on suggested matches.
MATCHES = ledger.Kind(("suggestion_id",), ("decision", "reviewer", "reviewed_at", "reviewer_comment"), "decision", ("approved", "rejected", "unresolved"), ("approved",))


def apply_matches(spark: SparkSession, extracted: str, resolved: str, decisions: str, out: str) -> Release:
    """Crosswalk and metrics with the approved suggestions applied; `decisions` is a ledger."""
    walk, suggestions = read(spark, resolved, "firm_identity_crosswalk"), read(spark, resolved, "firm_match_suggestions")
    updated = cut(identity.apply_decisions(suggestions, ledger.Ledger(spark, decisions, MATCHES).latest(), walk), "crosswalk")
    return publish(spark, out, {"firm_identity_crosswalk": updated, "complaint_metrics_resolved": _resolved(read(spark, extracted, "complaint_metrics"), updated)}, {"firm_identity_crosswalk": (packs.AsMany("crosswalk_rows_preserved", "firm_identity_crosswalk"),)})


def analyse(spark: SparkSession, resolved: str, out: str, decisions: str = "") -> Release:
    """The star schema under its rules; `decisions` is a ledger of quality reviews of metric cells."""
    metrics = read(spark, resolved, "complaint_metrics_resolved")
    reviewed = None
    if decisions:
        reviewed = ledger.Ledger(spark, decisions, ledger.QUALITY).latest().withColumns({c: F.col(c).cast("int") for c in ("source_row", "source_column")})
    fact = cut(star.facts(metrics, reviewed), "facts")
    groups = fact.select("product_group").distinct()
    products = marts.product_dim(groups).withColumns({"product_key": F.concat(F.lit("PRODUCT:"), "product_group"), "is_grand_total": F.col("product_group") == "grand_total"})
    tables = {"metrics": metrics, "dim_firm": star.firm_dim(fact), "dim_reporting_period": marts.period_dim(fact.select("reporting_period").distinct()), "dim_product_group": products, "dim_metric": star.metric_dim(fact), "fact_firm_complaints": fact}
    return publish(spark, out, tables, {"fact_firm_complaints": packs.FACTS})


def features(spark: SparkSession, analysed: str, out: str) -> Release:
    """The panel with trends and peer ranks, and the peer benchmarks."""
    wide = cut(panel.add_trends(panel.pivot_facts(read(spark, analysed, "fact_firm_complaints"))), "features")
    unique = packs.Unique("observation_unique", tuple(panel.OBS))
    return publish(spark, out, {"complaint_features": panel.add_percentiles(wide), "peer_benchmarks": panel.benchmarks(wide)}, {"complaint_features": (packs.Size("features_not_empty", 1), unique), "peer_benchmarks": (packs.Unique("benchmark_unique", tuple(panel.PEER)),)})


def _methodology(spark: SparkSession, path: str) -> dict:
    return M.validated(json.loads(text_of(spark, path))) if path else M.standard(True)


def warnings(spark: SparkSession, featured: str, out: str, methodology: str = "") -> Release:
    """Indicators, observation and firm summaries under a methodology (JSON on one line; the revised standard one if not given)."""
    m = _methodology(spark, methodology)
    prepared = settled(rules.prepare(settled(read(spark, featured, "complaint_features"), "features")), "prepared")
    summary = cut(rules.summary(prepared, m), "summary")
    snapshot = spark.createDataFrame([(m["methodology_id"], m["methodology_status"], json.dumps(m, sort_keys=True))], "methodology_id string, methodology_status string, methodology string")
    tables = {"prepared_features": prepared, "warning_indicators": rules.indicators(prepared, m), "firm_product_warning_summary": summary, "firm_period_warning_summary": rules.firm_rollup(summary), "warning_methodology_snapshot": snapshot}
    bands = ", ".join(f"'{b}'" for b in rules.BANDS)
    return publish(spark, out, tables, {"firm_product_warning_summary": (packs.AsMany("summary_rows_preserved", "prepared_features"), packs.Unique("summary_unique", tuple(rules.OBS)), packs.Row("band_known", f"priority_band IN ({bands})"))})


def validate(spark: SparkSession, featured: str, warned: str, out: str, methodology: str = "") -> Release:
    """Sensitivity of bands to the methodology's settings, stability of each observation, and the current cases to look at."""
    m = _methodology(spark, methodology)
    runs = cut(rules.sensitivity(read(spark, warned, "prepared_features"), m), "sensitivity")
    scenario = runs.groupBy("scenario_id", "priority_band").agg(F.count("*").alias("observation_count"), F.avg("warning_score").alias("mean_warning_score"))
    return publish(spark, out, {"scenario_bands": scenario, "band_stability": rules.band_stability(read(spark, warned, "prepared_features"), m), "review_sample": review.select_sample(_named(spark, warned))})


def _named(spark: SparkSession, warned: str, firms: DataFrame | None = None) -> DataFrame:
    summary = read(spark, warned, "firm_product_warning_summary")
    return summary.withColumn("display_firm_name", F.col("firm_key")) if firms is None else checked_join(summary, firms.select("firm_key", "display_firm_name"), ["firm_key"], "left", "m:1")


def report(spark: SparkSession, warned: str, analysed: str, out: str) -> Release:
    """Dashboard marts and the executive tables."""
    products = read(spark, analysed, "dim_product_group").filter("NOT is_grand_total").select("product_group", "product_group_label", "display_order")
    firms = read(spark, analysed, "dim_firm")
    product = cut(marts.firm_product(_named(spark, warned, firms), marts.period_dim(read(spark, warned, "firm_product_warning_summary").select("reporting_period").distinct()), products), "mart")
    tables = {
        "dashboard_firm_product_period": product, "dashboard_firm_period": marts.firm_period(product), "dashboard_rule_detail": marts.rule_detail(read(spark, warned, "warning_indicators"), product), "executive_kpis": marts.kpis(product), "executive_period_trend": marts.trend(product),
        "executive_product_snapshot": marts.snapshot(product), "priority_queue": marts.priority_queue(product), "insufficient_queue": marts.insufficient_queue(read(spark, warned, "firm_product_warning_summary"), read(spark, warned, "warning_indicators")),
        "mart_manifest": spark.createDataFrame([("MART-" + name, name) for name in ("firm_product_period", "firm_period", "rule_detail")], "id string, mart string").withColumn("notice", F.lit(marts.NOTICE)).withColumn("key", stable_key("KEY", F.col("mart"))),
    }
    return publish(spark, out, tables, {"dashboard_firm_product_period": (packs.Unique("mart_unique", tuple(rules.OBS)), packs.Row("firm_named", "display_firm_name IS NOT NULL")), "executive_kpis": (packs.Row("latest_period_present", "coalesce(latest_reporting_period, '') <> ''"),)})


COMMANDS: dict[str, Callable[..., Release]] = {f.__name__: f for f in (profile, extract, resolve, apply_matches, analyse, features, warnings, validate, report)}


def parser() -> argparse.ArgumentParser:
    """A command for each driver, with an option for each of its arguments."""
    top = argparse.ArgumentParser(prog="veldspar", description="From workbooks to dashboards, release by release.")
    each = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        p = each.add_parser(name, help=(f.__doc__ or "").split(";")[0])
        for a in list(inspect.signature(f).parameters.values())[1:]:
            p.add_argument(f"--{a.name.replace('_', '-')}", dest=a.name, required=a.default is a.empty, default=None if a.default is a.empty else a.default)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Release:
    from veldspar.session import session

    asked = vars(parser().parse_args(argv))
    release = COMMANDS[asked.pop("command")](spark or session(app="veldspar"), **asked)
    print(json.dumps({"version": release.version, "rows": release.rows, "issues": release.issues}))
    return release


if __name__ == "__main__":
    main()
