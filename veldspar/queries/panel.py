"""Panel, peer statistics, rule engine, sensitivity and marts over the panel that order lines host."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.contracts import checked_join
from veldspar.functions.semantics import period_end, period_start
from veldspar.operators import marts, review
from veldspar.plans import methodology, panel, rules
from veldspar.store import cut, named

#: Support settings that this panel can reach; the smallest scale has 8 to 10 peers.
REVISED = methodology.standard(True, closed=4, large=10, peers=20)
FIRST = methodology.standard(False, peers=20)
SMOKE = methodology.standard(True, closed=4, large=10, peers=5)

#: Priority from a score of 3, so that cases persist at every scale; and classification only with every rule eligible.
EARLY = {**SMOKE, "priority_bands": [{"minimum_score": n, "label": b} for n, b in ((3, "priority_review"), (2, "review"), (1, "monitor"), (0, "no_current_signal"))]}
STRICT = {**REVISED, "minimum_eligible_rules_for_classification": len(REVISED["rules"])}

R6 = lambda c: F.round(c, 6)


def _rounded(df, skip=()):
    return df.select([R6(F.col(c)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


# ---- SQL fragments ---------------------------------------------------------------------------------------------------

PANEL_SQL = """
li AS (
  SELECT 'SUPP:' || l_suppkey AS firm_key, p_type AS product_group,
    year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-H1' ELSE '-H2' END AS reporting_period,
    CASE WHEN month(o_orderdate) <= 6 THEN year(o_orderdate) || '-01-01 to ' || year(o_orderdate) || '-06-30'
         ELSE year(o_orderdate) || '-07-01 to ' || year(o_orderdate) || '-12-31' END AS source_reporting_period,
    l_linestatus = 'F' AS f, l_returnflag = 'R' AS r, l_discount AS d, l_quantity AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
obs AS (
  SELECT firm_key, product_group, reporting_period, source_reporting_period,
    count(*)::DOUBLE AS complaints_opened_count, count(*) FILTER (f)::DOUBLE AS complaints_closed_count,
    CASE WHEN count(*) FILTER (f) > 0 THEN count(*) FILTER (f AND r)::DOUBLE / count(*) FILTER (f) END AS complaints_upheld_pct,
    count(*) FILTER (d < 0.035::DOUBLE)::DOUBLE / count(*) AS closed_within_3_days_pct,
    count(*) FILTER (d >= 0.035::DOUBLE AND d < 0.085::DOUBLE)::DOUBLE / count(*) AS closed_after_3_days_within_8_weeks_pct,
    1000.0::DOUBLE * count(*) / sum(q) AS context_provision_rate, 1000.0::DOUBLE * count(*) FILTER (r) / sum(q) AS context_intermediation_rate
  FROM li GROUP BY 1, 2, 3, 4)"""
_ORDER = "PARTITION BY firm_key, product_group ORDER BY observation_end, reporting_period, source_reporting_period"
FEAT_SQL = (
    PANEL_SQL
    + """,
win AS (SELECT *, CAST(split_part(source_reporting_period, ' to ', 1) AS DATE) AS observation_start, CAST(split_part(source_reporting_period, ' to ', 2) AS DATE) AS observation_end FROM obs),
lagged AS (SELECT *, """
    + ", ".join(f"lag({f}) OVER ({_ORDER}) AS previous_{f}" for f in panel.TREND)
    + """ FROM win),
feat AS (SELECT *, datediff('day', observation_start, observation_end) + 1 AS observation_days, """
    + ", ".join(f"{f} - previous_{f} AS change_{f}, CASE WHEN previous_{f} <> 0 THEN ({f} - previous_{f}) / previous_{f} END AS pct_change_{f}" for f in panel.TREND)
    + " FROM lagged)"
)


def _pct(f):
    g = "PARTITION BY reporting_period, product_group"
    return f"CASE WHEN {f} IS NOT NULL THEN (rank() OVER ({g} ORDER BY {f} NULLS LAST) + (count({f}) OVER ({g}, {f}) - 1) / 2.0::DOUBLE) / count({f}) OVER ({g}) END"


PREP_SQL = (
    FEAT_SQL
    + """,
late AS (SELECT *, CASE WHEN 1 - (closed_within_3_days_pct + closed_after_3_days_within_8_weeks_pct) BETWEEN 0 AND 1
  THEN 1 - (closed_within_3_days_pct + closed_after_3_days_within_8_weeks_pct) END AS closed_over_8_weeks_pct FROM feat),
prep AS (SELECT *, """
    + ", ".join(f"{_pct(f)} AS {f}_peer_percentile, count({f}) OVER (PARTITION BY reporting_period, product_group) AS {f}_peer_count" for f in rules.PEER_FEATURES)
    + " FROM late)"
)


def _rules_sql(m, name="", source="prep"):
    """Rows for each rule (long form), then observation summaries: another shape than the engine's wide one."""
    parts = []
    for r in m["rules"]:
        missing = " OR ".join(f"{c['feature']} IS NULL" for c in r["conditions"])
        met = " AND ".join(f"{c['feature']} {c['operator'].replace('==', '=')} {float(c['threshold'])}::DOUBLE" for c in r["conditions"])
        peer = f"{r['peer_count_feature']} >= {m['minimum_peer_size']}"
        parts.append(
            f"SELECT firm_key, reporting_period, source_reporting_period, product_group, observation_end, '{r['rule_id']}' AS rule_id, '{r['category']}' AS rule_category,"
            f" '{r.get('score_family', r['category'])}' AS score_family, {r['points']} AS points, {r['peer_count_feature']} AS peer_count, NOT ({missing}) AND {peer} AS eligible,"
            f" coalesce(NOT ({missing}) AND {peer} AND {met}, false) AS triggered,"
            f" CASE WHEN {missing} THEN 'missing_required_feature' WHEN NOT {peer} THEN 'peer_group_below_minimum' WHEN {met} THEN 'conditions_met' ELSE 'conditions_not_met' END AS eligibility_reason FROM {source}"
        )
    caps = "CASE score_family " + " ".join(f"WHEN '{f}' THEN {c}" for f, c in m.get("family_point_caps", {"none": 0}).items()) + " ELSE 1000 END"
    bands = "CASE " + " ".join(f"WHEN warning_score >= {b['minimum_score']} THEN '{b['label']}'" for b in sorted(m["priority_bands"], key=lambda b: -b["minimum_score"])) + " END"
    keys = "firm_key, reporting_period, source_reporting_period, product_group"
    return f""",
ind0{name} AS ({" UNION ALL ".join(parts)}),
ind{name} AS (SELECT *, triggered AND coalesce(lag(triggered) OVER (PARTITION BY firm_key, product_group, rule_id ORDER BY observation_end, reporting_period, source_reporting_period), false) AS persistent_trigger,
  CASE WHEN triggered THEN points ELSE 0 END AS base_points FROM ind0{name}),
fam{name} AS (SELECT *, least(pts, {caps}) AS capped FROM (SELECT {keys}, score_family, sum(base_points) AS pts FROM ind{name} GROUP BY ALL)),
tot{name} AS (SELECT {keys}, sum(pts)::INT AS uncapped_base_warning_score, sum(capped)::INT AS base_warning_score FROM fam{name} GROUP BY ALL),
cnt{name} AS (SELECT {keys}, count(*) FILTER (eligible)::INT AS eligible_rule_count, count(*) FILTER (triggered)::INT AS triggered_rule_count, count(*) FILTER (persistent_trigger)::INT AS persistent_rule_count,
  coalesce(string_agg(rule_id, '|' ORDER BY rule_id) FILTER (triggered), '') AS triggered_rule_ids FROM ind{name} GROUP BY ALL),
sc{name} AS (SELECT *, uncapped_base_warning_score - base_warning_score AS point_cap_reduction, least(persistent_rule_count, {m["maximum_persistence_bonus"]})::INT AS persistence_bonus,
  base_warning_score + least(persistent_rule_count, {m["maximum_persistence_bonus"]})::INT AS warning_score FROM cnt{name} JOIN tot{name} USING ({keys})),
summ{name} AS (SELECT *, CASE WHEN eligible_rule_count >= 6 THEN 'broad' WHEN eligible_rule_count >= {m["minimum_eligible_rules_for_classification"]} THEN 'partial' ELSE 'limited' END AS coverage_status,
  CASE WHEN eligible_rule_count < {m["minimum_eligible_rules_for_classification"]} THEN 'insufficient_data' ELSE {bands} END AS priority_band FROM sc{name})"""


RULE_SQL = PREP_SQL + _rules_sql(REVISED)
KEYS = "firm_key, reporting_period, source_reporting_period, product_group"
SUMMARY = "eligible_rule_count, triggered_rule_count, persistent_rule_count, triggered_rule_ids, uncapped_base_warning_score, base_warning_score, point_cap_reduction, persistence_bonus, warning_score, coverage_status, priority_band"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- panel and peers -------------------------------------------------------------------------------------------------


@query(f"WITH {PANEL_SQL} SELECT {KEYS}, complaints_opened_count, complaints_closed_count, " + ", ".join(f"round({f}, 6) AS {f}" for f in panel.TREND[1:]) + " FROM obs")
def panel_features(spark, sf):
    return _rounded(panel.order_panel(spark, sf))


_T = [f"{p}_{f}" for f in panel.TREND for p in ("previous", "change", "pct_change")]


@query(f"WITH {FEAT_SQL} SELECT {KEYS}, observation_start, observation_end, observation_days::INT AS observation_days, " + ", ".join(f"round({c}, 6) AS {c}" for c in _T) + " FROM feat")
def panel_trends(spark, sf):
    return _rounded(panel.order_features(spark, sf).select(*panel.OBS, "observation_start", "observation_end", "observation_days", *_T))


@query(f"WITH {PANEL_SQL} SELECT {KEYS}, " + ", ".join(f"round({_pct(f)}, 6) AS {f}_peer_percentile" for f in panel.TREND) + " FROM obs")
def peer_percentile_rank(spark, sf):
    return _rounded(panel.add_percentiles(panel.order_panel(spark, sf)).select(*panel.OBS, *[f"{f}_peer_percentile" for f in panel.TREND]))


@query(
    f"WITH {PANEL_SQL} SELECT reporting_period, product_group, "
    + ", ".join(f"count({f}) AS {f}_count, round(quantile_cont({f}, 0.25), 6) AS {f}_q1, round(quantile_cont({f}, 0.5), 6) AS {f}_median, round(quantile_cont({f}, 0.75), 6) AS {f}_q3" for f in panel.TREND)
    + " FROM obs GROUP BY 1, 2"
)
def peer_benchmarks_quartiles(spark, sf):
    return _rounded(panel.benchmarks(panel.order_panel(spark, sf)))


_LONG = [(s, m, u, f) for (s, m, u), f in panel.FEATURES.items() if s != "consumer_credit"]


@query(f"WITH {PANEL_SQL} SELECT {KEYS}, complaints_opened_count, complaints_closed_count, NULL::DOUBLE AS complaints_upheld_count, " + ", ".join(f"round({f}, 6) AS {f}" for f in panel.TREND[1:]) + " FROM obs")
def pivot_long_to_wide(spark, sf):
    """The panel as long facts, then wide again through the fact contract."""
    p = panel.order_panel(spark, sf)
    cell = lambda s, m, u, f: F.struct(F.lit(s).alias("canonical_sheet"), F.lit(m).alias("metric_name"), F.lit(u).alias("measurement_unit"), F.col(f).alias("metric_value"))
    fact = p.select(*panel.OBS, F.explode(F.array(*[cell(*x) for x in _LONG])).alias("m")).select(*panel.OBS, "m.*")
    fact = fact.withColumns({"is_analysis_ready_value": F.lit(True), "is_product_level": F.lit(True)})
    return _rounded(panel.pivot_facts(fact))


@query(f"WITH {PANEL_SQL} SELECT firm_key, reporting_period, product_group, indicator, round(value, 6) AS value FROM (SELECT {KEYS}, {', '.join(panel.TREND)} FROM obs) UNPIVOT INCLUDE NULLS (value FOR indicator IN ({', '.join(panel.TREND)}))")
def unpivot_wide_to_long(spark, sf):
    p = panel.order_panel(spark, sf)
    return _rounded(p.unpivot(["firm_key", "reporting_period", "product_group"], panel.TREND, "indicator", "value"))


# ---- rule engine -----------------------------------------------------------------------------------------------------


def _prepared(spark, sf):
    """Features with peer statistics, which every methodology reads; a named table."""
    return named(spark, "order-prepared", panel.order_sources(sf), lambda: rules.prepare(panel.order_features(spark, sf)))


def _summary(spark, sf, m=REVISED):
    """Observations judged by a methodology; a named table for each, which marts and queues read."""
    return named(spark, "order-summary", panel.order_sources(sf), lambda: rules.summary(_prepared(spark, sf), m), methodology=m)


def _indicators(spark, sf, m=REVISED):
    return rules.indicators(_prepared(spark, sf), m)


@query(f"WITH {RULE_SQL} SELECT {KEYS}, {SUMMARY} FROM summ")
def rule_engine_summary(spark, sf):
    return _summary(spark, sf).select(*panel.OBS, *[c.strip() for c in SUMMARY.split(",")])


@query(f"WITH {RULE_SQL} SELECT {KEYS}, rule_id, rule_category, score_family, eligible, triggered, eligibility_reason, peer_count, base_points, persistent_trigger FROM ind")
def rule_engine_indicators(spark, sf):
    return _indicators(spark, sf).select(*panel.OBS, "rule_id", "rule_category", "score_family", "eligible", "triggered", "eligibility_reason", "peer_count", "base_points", "persistent_trigger")


@query(f"WITH {PREP_SQL}{_rules_sql(SMOKE)} SELECT reporting_period, priority_band, count(*) AS observation_count, sum(warning_score)::BIGINT AS total_score FROM summ GROUP BY 1, 2")
def rule_engine_band_counts(spark, sf):
    return _summary(spark, sf, SMOKE).groupBy("reporting_period", "priority_band").agg(F.count("*").alias("observation_count"), F.sum("warning_score").alias("total_score"))


@query(f"WITH {RULE_SQL} SELECT rule_id, count(*) FILTER (triggered) AS triggered, count(*) FILTER (persistent_trigger) AS persistent FROM ind GROUP BY 1")
def rule_persistence(spark, sf):
    return _indicators(spark, sf).groupBy("rule_id").agg(F.count_if("triggered").alias("triggered"), F.count_if("persistent_trigger").alias("persistent"))


@query(
    f"""WITH {RULE_SQL} SELECT firm_key, reporting_period, count(*) AS product_observation_count,
coalesce(string_agg(DISTINCT product_group, '|' ORDER BY product_group) FILTER (triggered_rule_count > 0), '') AS products_with_signals,
coalesce(string_agg(DISTINCT product_group, '|' ORDER BY product_group) FILTER (priority_band = 'priority_review'), '') AS products_priority_review,
max(warning_score) AS maximum_product_warning_score, sum(triggered_rule_count)::BIGINT AS total_triggered_rules, sum(persistent_rule_count)::BIGINT AS total_persistent_rules,
count(*) FILTER (priority_band = 'insufficient_data') AS insufficient_data_products FROM summ GROUP BY 1, 2"""
)
def firm_period_rollup(spark, sf):
    return rules.firm_rollup(_summary(spark, sf))


@query(f"WITH {RULE_SQL} SELECT {KEYS}, score_family, capped::INT AS capped FROM fam")
def json_family_evidence(spark, sf):
    """Family scores as a native map, through JSON and back."""
    s = _summary(spark, sf).select(*panel.OBS, F.from_json(F.to_json("family_scores"), "map<string,int>").alias("m"))
    return s.select(*panel.OBS, F.explode("m").alias("score_family", "capped"))


# ---- sensitivity -----------------------------------------------------------------------------------------------------

_SCENARIOS = methodology.scenarios(REVISED)
_SENS_SQL = PREP_SQL + "".join(_rules_sql(m, f"_{i}") for i, (_, m) in enumerate(_SCENARIOS)) + ", sens AS (" + " UNION ALL ".join(f"SELECT '{n}' AS scenario_id, {KEYS}, triggered_rule_count, persistent_rule_count, warning_score, priority_band FROM summ_{i}" for i, (n, _) in enumerate(_SCENARIOS)) + ")"


@query(
    f"WITH {_SENS_SQL} SELECT scenario_id, count(*) AS observation_count, sum(triggered_rule_count)::BIGINT AS triggered_rule_count, sum(persistent_rule_count)::BIGINT AS persistent_rule_count, round(avg(warning_score), 6) AS mean_warning_score, max(warning_score) AS maximum_warning_score, "
    + ", ".join(f"count(*) FILTER (priority_band = '{b}') AS band_{b}" for b in rules.BANDS)
    + " FROM sens GROUP BY 1"
)
def sensitivity_scenarios(spark, sf):
    s = rules.sensitivity(_prepared(spark, sf), REVISED)
    return s.groupBy("scenario_id").agg(
        F.count("*").alias("observation_count"), F.sum("triggered_rule_count").alias("triggered_rule_count"), F.sum("persistent_rule_count").alias("persistent_rule_count"), R6(F.avg("warning_score")).alias("mean_warning_score"), F.max("warning_score").alias("maximum_warning_score"),
        *[F.count_if(F.col("priority_band") == b).alias(f"band_{b}") for b in rules.BANDS],
    )


@query(f"WITH {_SENS_SQL} SELECT s.scenario_id, b.priority_band AS baseline_priority_band, s.priority_band AS scenario_priority_band, count(*) AS observation_count FROM sens s JOIN sens b USING ({KEYS}) WHERE b.scenario_id = 'baseline' GROUP BY 1, 2, 3")
def band_transitions(spark, sf):
    """The baseline band stands beside the observation's scenarios in one row, so that only counts are shuffled."""
    s = rules.scenario_bands(_prepared(spark, sf), REVISED).selectExpr("filter(runs, x -> x.scenario_id = 'baseline')[0].priority_band AS baseline_priority_band", "inline(runs)")
    return s.groupBy("scenario_id", "baseline_priority_band", F.col("priority_band").alias("scenario_priority_band")).agg(F.count("*").alias("observation_count"))


@query(
    f"""WITH {_SENS_SQL} SELECT {KEYS}, max(priority_band) FILTER (scenario_id = 'baseline') AS baseline_priority_band, max(warning_score) FILTER (scenario_id = 'baseline') AS baseline_warning_score, min(warning_score) AS minimum_scenario_score,
max(warning_score) AS maximum_scenario_score, count(DISTINCT priority_band)::INT AS distinct_scenario_bands, string_agg(DISTINCT priority_band, '|' ORDER BY priority_band) AS scenario_bands, count(*) FILTER (priority_band = bb)::INT AS scenarios_same_as_baseline,
count(*) AS scenario_count, round(count(*) FILTER (priority_band = bb) / count(*), 6) AS band_stability_rate
FROM (SELECT *, max(priority_band) FILTER (scenario_id = 'baseline') OVER (PARTITION BY {KEYS}) AS bb FROM sens) GROUP BY {KEYS}"""
)
def band_stability(spark, sf):
    return _rounded(rules.band_stability(_prepared(spark, sf), REVISED))


@query(f"WITH {_SENS_SQL} SELECT scenario_id, {KEYS}, warning_score FROM sens WHERE scenario_id IN ('baseline', 'priority_upper') AND priority_band = 'priority_review'")
def union_scenarios(spark, sf):
    """UNION ALL of two scenario runs, each with its own plan."""
    runs = dict(_SCENARIOS)
    one = lambda n: _summary(spark, sf, runs[n]).filter("priority_band = 'priority_review'").select(F.lit(n).alias("scenario_id"), *panel.OBS, "warning_score")
    return one("baseline").unionByName(one("priority_upper"))


# ---- review and marts ------------------------------------------------------------------------------------------------

_NAMES = ", named AS (SELECT summ.*, s_name AS display_firm_name FROM summ JOIN supplier ON firm_key = 'SUPP:' || s_suppkey)"
_NAMED = RULE_SQL + _NAMES
_SAMPLE_SQL = (
    _NAMED
    + """, cur AS (SELECT * FROM named WHERE reporting_period = (SELECT max(reporting_period) FROM named)),
sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY priority_band ORDER BY
  CASE WHEN priority_band = 'insufficient_data' THEN -triggered_rule_count ELSE -warning_score END,
  CASE WHEN priority_band = 'insufficient_data' THEN eligible_rule_count ELSE -triggered_rule_count END, display_firm_name, product_group) AS rn FROM cur) WHERE rn <= 5)"""
)


def _named(spark, sf, m=REVISED):
    firms = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("SUPP:"), F.col("s_suppkey").cast("string")).alias("firm_key"), F.col("s_name").alias("display_firm_name"))
    return _summary(spark, sf, m).join(firms, "firm_key")


@query(f"WITH {_SAMPLE_SQL} SELECT {KEYS}, display_firm_name, priority_band, warning_score, rn::INT AS band_rank, 'pending_case_review' AS review_status FROM sample")
def stratified_sample(spark, sf):
    return review.select_sample(_named(spark, sf), 5).select(*panel.OBS, "display_firm_name", "priority_band", "warning_score", "band_rank", "review_status")


@query(f"WITH {_SAMPLE_SQL} SELECT {KEYS}, rule_id, eligible, triggered FROM sample JOIN ind USING ({KEYS})")
def sample_drilldown(spark, sf):
    sample = cut(review.select_sample(_named(spark, sf), 5).select(*panel.OBS), "drilldown-sample")
    found = _indicators(spark, sf).join(F.broadcast(sample), panel.OBS, "left_semi")  # five rows for each band
    return checked_join(sample, found, panel.OBS, "left", "1:m", large=True).select(*panel.OBS, "rule_id", "eligible", "triggered")


_V12 = PREP_SQL + _rules_sql(FIRST, "_v1") + _rules_sql(REVISED, "_v2")


@query(f"WITH {_V12} SELECT {KEYS}, a.priority_band AS priority_band_v1, b.priority_band AS priority_band_v2, a.priority_band <> b.priority_band AS band_changed, b.warning_score - a.warning_score AS score_change FROM summ_v1 a JOIN summ_v2 b USING ({KEYS})")
def methodology_comparison(spark, sf):
    return review.compare(_summary(spark, sf, FIRST), _summary(spark, sf, REVISED)).select(*panel.OBS, "priority_band_v1", "priority_band_v2", "band_changed", "score_change")


@query(
    f"""WITH {RULE_SQL}, fams AS (SELECT {KEYS}, count(DISTINCT score_family) AS fc, string_agg(DISTINCT score_family, '|' ORDER BY score_family) AS triggered_signal_families,
coalesce(string_agg(DISTINCT rule_id, '|' ORDER BY rule_id) FILTER (persistent_trigger), '') AS persistent_trigger_ids FROM ind WHERE triggered GROUP BY ALL),
pr AS (SELECT *, concat_ws('|', CASE WHEN complaints_closed_count < 50 THEN 'low_closed_denominator_20_to_49' END, CASE WHEN context_provision_rate > 1000 OR context_intermediation_rate > 1000 THEN 'context_rate_above_1000_check_units' END,
  CASE WHEN firm_key LIKE '%7' THEN 'firm_identity_unmatched' END) AS review_flags
  FROM summ JOIN fams USING ({KEYS}) JOIN (SELECT {KEYS}, complaints_closed_count, context_provision_rate, context_intermediation_rate FROM obs) USING ({KEYS}) WHERE priority_band = 'priority_review')
SELECT {KEYS}, fc AS independent_signal_family_count, triggered_signal_families, persistent_trigger_ids, review_flags,
  CASE WHEN review_flags <> '' THEN 'source_check_required_before_reliance' WHEN fc >= 3 OR warning_score >= 9 THEN 'retain_priority_review' ELSE 'retain_priority_review_borderline' END AS review_disposition FROM pr"""
)
def priority_review_flags(spark, sf):
    f = panel.order_features(spark, sf).withColumn("identity_match_status", F.when(F.col("firm_key").endswith("7"), "unmatched").otherwise("matched"))
    f = f.withColumn("closed_within_8_weeks_pct", F.col("closed_within_3_days_pct") + F.col("closed_after_3_days_within_8_weeks_pct")).withColumn("closed_within_8_weeks_pct", F.when(F.col("closed_within_8_weeks_pct") <= 1, F.col("closed_within_8_weeks_pct")))
    out = review.priority_reviews(_summary(spark, sf), _indicators(spark, sf), f)
    return out.select(*panel.OBS, "independent_signal_family_count", "triggered_signal_families", "persistent_trigger_ids", "review_flags", "review_disposition")


_MART = (
    """, prods AS (SELECT p_type AS product_group, row_number() OVER (ORDER BY p_type) AS display_order FROM (SELECT DISTINCT p_type FROM part)),
mart AS (SELECT named.*, display_order::INT AS display_order, CAST(left(reporting_period, 4) AS INT) AS year, CAST(right(reporting_period, 1) AS INT) AS half,
  CASE priority_band WHEN 'priority_review' THEN 1 WHEN 'review' THEN 2 WHEN 'monitor' THEN 3 WHEN 'no_current_signal' THEN 4 ELSE 5 END AS priority_band_sort_order,
  triggered_rule_count > 0 AS has_current_signal, priority_band = 'priority_review' AS is_priority_review,
  reporting_period = (SELECT max(reporting_period) FROM named) AS is_latest_reporting_period,
  CASE WHEN priority_band = 'priority_review' THEN 'priority_review_pending' ELSE 'not_required' END AS review_display_status FROM named JOIN prods USING (product_group))"""
)
_MART_SQL = _NAMED + _MART
_EARLY_SQL = PREP_SQL + _rules_sql(EARLY) + _NAMES + _MART


def _mart(spark, sf, m=REVISED):
    products = marts.product_dim(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_type").alias("product_group")).distinct())
    summary = _named(spark, sf, m)
    periods = marts.period_dim(summary.select("reporting_period").distinct())
    return marts.firm_product(summary, periods, products)


@query(f"WITH {_MART_SQL} SELECT {KEYS}, display_firm_name, display_order, year, half, priority_band, priority_band_sort_order, warning_score, has_current_signal, is_priority_review, is_latest_reporting_period, review_display_status FROM mart")
def dashboard_firm_product(spark, sf):
    return _mart(spark, sf).select(*panel.OBS, "display_firm_name", "display_order", "year", "half", "priority_band", "priority_band_sort_order", "warning_score", "has_current_signal", "is_priority_review", "is_latest_reporting_period", "review_display_status")


@query(
    f"""WITH {_MART_SQL} SELECT firm_key, reporting_period, any_value(display_firm_name) AS display_firm_name, count(*) AS product_observation_count, count(*) FILTER (has_current_signal) AS products_with_current_signal, max(warning_score) AS maximum_warning_score,
sum(triggered_rule_count)::BIGINT AS total_triggered_rules, sum(persistent_rule_count)::BIGINT AS total_persistent_rules, """
    + ", ".join(f"count(*) FILTER (priority_band = '{b}') AS {b}_product_count" for b in rules.BANDS)
    + ", coalesce(string_agg(DISTINCT product_group, '|' ORDER BY product_group) FILTER (is_priority_review), '') AS priority_review_products, count(*) FILTER (is_priority_review) > 0 AS has_priority_review_product FROM mart GROUP BY 1, 2"
)
def dashboard_firm_period(spark, sf):
    return marts.firm_period(_mart(spark, sf))


@query(
    f"""WITH {_MART_SQL} SELECT {KEYS}, rule_id, priority_band, warning_score, CASE WHEN persistent_trigger THEN 'triggered_persistent' WHEN triggered THEN 'triggered' WHEN NOT eligible THEN 'ineligible' ELSE 'not_triggered' END AS rule_status
FROM ind JOIN mart USING ({KEYS})"""
)
def dashboard_rule_detail(spark, sf):
    return marts.rule_detail(_indicators(spark, sf), _mart(spark, sf)).select(*panel.OBS, "rule_id", "priority_band", "warning_score", "rule_status")


@query(
    f"""WITH {_MART_SQL} SELECT max(reporting_period) AS latest_reporting_period, count(DISTINCT firm_key) AS latest_firm_count, count(*) AS latest_firm_product_observations, count(*) FILTER (is_priority_review) AS latest_priority_observations,
count(DISTINCT firm_key) FILTER (is_priority_review) AS latest_priority_firms, count(*) FILTER (priority_band = 'insufficient_data') AS latest_insufficient_data_observations FROM mart WHERE is_latest_reporting_period"""
)
def executive_kpis(spark, sf):
    return marts.kpis(_mart(spark, sf))


@query(f"WITH {_MART_SQL} SELECT reporting_period, count(DISTINCT firm_key) AS firm_count, count(*) AS observation_count, " + ", ".join(f"count(*) FILTER (priority_band = '{b}') AS {b}" for b in rules.BANDS) + " FROM mart GROUP BY 1")
def executive_trend(spark, sf):
    return marts.trend(_mart(spark, sf))


@query(f"WITH {_MART_SQL} SELECT product_group, display_order, count(*) AS firm_observations, " + ", ".join(f"count(*) FILTER (priority_band = '{b}') AS {b}" for b in rules.BANDS if b != "no_current_signal") + " FROM mart WHERE is_latest_reporting_period GROUP BY 1, 2")
def executive_snapshot(spark, sf):
    return marts.snapshot(_mart(spark, sf))


@query(
    f"""WITH {_MART_SQL} SELECT 'Insufficient data' AS quality_measure, count(*) FILTER (priority_band = 'insufficient_data') AS observation_count FROM mart
UNION ALL SELECT 'Priority review', count(*) FILTER (is_priority_review) FROM mart UNION ALL SELECT 'Limited coverage', count(*) FILTER (coverage_status = 'limited') FROM mart"""
)
def quality_summary_stack(spark, sf):
    return marts.stacked(_mart(spark, sf), {"Insufficient data": F.col("priority_band") == "insufficient_data", "Priority review": F.col("is_priority_review"), "Limited coverage": F.col("coverage_status") == "limited"})


@query(
    f"""WITH {_EARLY_SQL}, h AS (SELECT firm_key, product_group, count(DISTINCT reporting_period) AS priority_periods, min(reporting_period) AS first_priority_period, max(reporting_period) AS last_priority_period,
max(warning_score) AS maximum_warning_score, count(*) FILTER (persistent_rule_count > 0) AS periods_with_persistent_rules FROM mart WHERE is_priority_review GROUP BY 1, 2),
l AS (SELECT firm_key, product_group, display_firm_name, warning_score AS latest_warning_score FROM mart WHERE is_priority_review AND is_latest_reporting_period),
t AS (SELECT *, row_number() OVER (ORDER BY priority_periods DESC, latest_warning_score DESC, display_firm_name, product_group) AS rn FROM l JOIN h USING (firm_key, product_group))
SELECT printf('PCR-%03d', rn) AS case_id, firm_key, product_group, priority_periods, first_priority_period, last_priority_period, maximum_warning_score, periods_with_persistent_rules, latest_warning_score FROM t WHERE rn <= 6"""
)
def topk_persistent_cases(spark, sf):
    return marts.persistent_cases(_mart(spark, sf, EARLY), 6).select("case_id", "firm_key", "product_group", "priority_periods", "first_priority_period", "last_priority_period", "maximum_warning_score", "periods_with_persistent_rules", "latest_warning_score")


_CASES_SQL = (
    _EARLY_SQL
    + """, h AS (SELECT firm_key, product_group, count(DISTINCT reporting_period) AS priority_periods FROM mart WHERE is_priority_review GROUP BY 1, 2),
l AS (SELECT firm_key, product_group, display_firm_name, warning_score FROM mart WHERE is_priority_review AND is_latest_reporting_period),
cases AS (SELECT printf('PCR-%03d', rn) AS case_id, firm_key, product_group FROM (SELECT *, row_number() OVER (ORDER BY priority_periods DESC, warning_score DESC, display_firm_name, product_group) AS rn FROM l JOIN h USING (firm_key, product_group)) WHERE rn <= 6)"""
)


@query(f"WITH {_CASES_SQL} SELECT case_id, {KEYS}, display_firm_name, warning_score, coverage_status, priority_band, triggered_rule_count, persistent_rule_count, triggered_rule_ids FROM mart JOIN cases USING (firm_key, product_group)")
def case_period_evidence(spark, sf):
    """All periods of the persistent cases."""
    m = _mart(spark, sf, EARLY)
    return marts.case_periods(marts.persistent_cases(m, 6), m).select("case_id", *panel.OBS, "display_firm_name", "warning_score", "coverage_status", "priority_band", "triggered_rule_count", "persistent_rule_count", "triggered_rule_ids")


@query(f"WITH {_CASES_SQL} SELECT case_id, {KEYS}, rule_id, rule_category, score_family, base_points, persistent_trigger, peer_count FROM ind JOIN cases USING (firm_key, product_group) WHERE triggered")
def case_rule_evidence(spark, sf):
    """Every rule that fired for the persistent cases."""
    found = marts.case_rules(marts.persistent_cases(_mart(spark, sf, EARLY), 6), _indicators(spark, sf, EARLY))
    return found.select("case_id", *panel.OBS, "rule_id", "rule_category", "score_family", "base_points", "persistent_trigger", "peer_count")


@query(
    f"""WITH {RULE_SQL} SELECT rule_id, rule_category, score_family, count(*) AS triggered_observations, count(*) FILTER (persistent_trigger) AS persistent_triggers, count(DISTINCT product_group) AS product_groups,
round(count(*) FILTER (persistent_trigger) / count(*), 6) AS persistent_share FROM ind WHERE triggered AND reporting_period = (SELECT max(reporting_period) FROM ind) GROUP BY 1, 2, 3"""
)
def work_queue_rule_drivers(spark, sf):
    return _rounded(marts.rule_drivers(_indicators(spark, sf)))


@query(
    f"""WITH {PREP_SQL}{_rules_sql(STRICT)}, ins AS (SELECT * FROM summ WHERE priority_band = 'insufficient_data' AND reporting_period = (SELECT max(reporting_period) FROM summ))
SELECT {KEYS}, eligible_rule_count, count(*) FILTER (eligibility_reason = 'missing_required_feature') AS missing_required_feature, count(*) FILTER (eligibility_reason = 'peer_group_below_minimum') AS peer_group_below_minimum,
string_agg(DISTINCT score_family, '|' ORDER BY score_family) AS ineligible_signal_families,
CASE WHEN count(*) FILTER (eligibility_reason = 'peer_group_below_minimum') > 0 THEN 'review_peer_group_minimum_and_do_not_classify' ELSE 'restore_or_source_missing_features' END AS recommended_treatment
FROM ins JOIN ind USING ({KEYS}) WHERE NOT eligible GROUP BY {KEYS}, eligible_rule_count"""
)
def work_queue_insufficient(spark, sf):
    return marts.insufficient_queue(_summary(spark, sf, STRICT), _indicators(spark, sf, STRICT))


@query(f"WITH {_EARLY_SQL} SELECT {KEYS}, display_firm_name, warning_score, coverage_status, triggered_rule_count, persistent_rule_count, triggered_rule_ids, row_number() OVER (ORDER BY warning_score DESC, display_firm_name, product_group)::INT AS queue_position FROM mart WHERE is_latest_reporting_period AND is_priority_review")
def work_queue_priority(spark, sf):
    """Current priority cases in the order in which they are worked on."""
    return marts.priority_queue(_mart(spark, sf, EARLY)).select(*panel.OBS, "display_firm_name", "warning_score", "coverage_status", "triggered_rule_count", "persistent_rule_count", "triggered_rule_ids", "queue_position")


@query(
    f"""WITH {_EARLY_SQL}, w AS (SELECT {KEYS}, string_agg(rule_id, '|' ORDER BY rule_id) AS rebuilt FROM ind WHERE triggered GROUP BY ALL)
SELECT {KEYS}, display_firm_name, priority_band, complaints_opened_count, previous_complaints_opened_count, round(pct_change_complaints_opened_count, 6) AS pct_change_complaints_opened_count, warning_score, coverage_status, rebuilt AS triggered_rule_ids_rebuilt
FROM mart JOIN (SELECT {KEYS}, complaints_opened_count, previous_complaints_opened_count, pct_change_complaints_opened_count FROM feat) USING ({KEYS}) LEFT JOIN w USING ({KEYS})
WHERE is_latest_reporting_period AND product_group = (SELECT min(p_type) FROM part) AND priority_band IN ('monitor', 'review')"""
)
def work_queue_monitoring(spark, sf):
    """Current monitor and review observations of one product, with the rules that fired."""
    product = spark.read.parquet(f"{sf}/part.parquet").agg(F.min("p_type")).first()[0]
    numbers = panel.order_features(spark, sf).select(*panel.OBS, "complaints_opened_count", "previous_complaints_opened_count", "pct_change_complaints_opened_count")
    return _rounded(marts.monitoring_queue(checked_join(_mart(spark, sf, EARLY), numbers, panel.OBS, large=True), _indicators(spark, sf, EARLY), product)).select(*panel.OBS, "display_firm_name", "priority_band", "complaints_opened_count", "previous_complaints_opened_count", "pct_change_complaints_opened_count", "warning_score", "coverage_status", "triggered_rule_ids_rebuilt")


@query(
    f"""WITH {PREP_SQL}{_rules_sql(STRICT)} SELECT product_group, count(*) AS insufficient_observations, count(*) FILTER (eligible_rule_count = 0) AS zero_eligible_rules, count(*) FILTER (eligible_rule_count IN (1, 2)) AS one_or_two_eligible_rules
FROM summ WHERE priority_band = 'insufficient_data' AND reporting_period = (SELECT max(reporting_period) FROM summ) GROUP BY 1"""
)
def work_queue_coverage(spark, sf):
    """How far from classification the current insufficient observations of each product are."""
    return marts.coverage_gaps(marts.insufficient_queue(_summary(spark, sf, STRICT), _indicators(spark, sf, STRICT)))


_CONTEXT = ["complaints_upheld_pct", "closed_within_3_days_pct", "context_provision_rate"]


@query(
    f"""WITH {PANEL_SQL}, g AS (SELECT reporting_period, product_group, count(*) AS firm_observation_count, count(DISTINCT firm_key) AS distinct_firm_count, coalesce(sum(complaints_opened_count), 0) AS complaints_opened_total,
{", ".join(f"round(median({f}), 6) AS {f}_median" for f in _CONTEXT)} FROM obs GROUP BY 1, 2), p AS (SELECT *, lag(complaints_opened_total) OVER (PARTITION BY product_group ORDER BY reporting_period) AS previous_total FROM g)
SELECT *, complaints_opened_total - previous_total AS change_total, round((complaints_opened_total - previous_total) / nullif(previous_total, 0), 6) AS pct_change_total FROM p"""
)
def product_period_context(spark, sf):
    return _rounded(marts.product_period(panel.order_panel(spark, sf), _CONTEXT))


@query(
    f"""WITH {RULE_SQL} SELECT rule AS rule, n::BIGINT AS count, 'error' AS severity FROM (
SELECT 'closed_covers_opened' AS rule, count(*) FILTER (complaints_closed_count < complaints_opened_count) AS n FROM obs UNION ALL
SELECT 'upheld_known', count(*) FILTER (complaints_upheld_pct IS NULL) FROM obs UNION ALL
SELECT 'rates_positive', count(*) FILTER (NOT context_provision_rate > 0) FROM obs) WHERE n > 0"""
)
def validation_issues(spark, sf):
    from veldspar.contracts import issues

    checks = {"closed_covers_opened": F.col("complaints_closed_count") >= F.col("complaints_opened_count"), "upheld_known": F.col("complaints_upheld_pct").isNotNull(), "rates_positive": F.col("context_provision_rate") > 0}
    return issues(panel.order_panel(spark, sf), checks)
