"""The rule engine, compiled to SQL expressions.

Rules are evaluated side by side on the observation row instead of on a row for each rule. Which rules are eligible and
triggered is held in bits of a long, so that counts are bit counts under a mask, capped family points are sums of them,
and persistence is one lag of one number. Each rule becomes one SQL string once: the driver parses a few strings rather
than building thousands of columns. The scenarios of a sensitivity run share the bits of all conditions that they don't
change, and the two exchanges. Rows for each rule, or for each scenario, are only made at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.plans import peers
from veldspar.plans.methodology import OPERATORS, scenarios

OBS = ["firm_key", "reporting_period", "source_reporting_period", "product_group"]
PEER = ["reporting_period", "product_group"]
PEER_FEATURES = ["complaints_opened_count", "context_provision_rate", "context_intermediation_rate", "complaints_upheld_pct", "closed_within_3_days_pct", "closed_after_3_days_within_8_weeks_pct", "closed_over_8_weeks_pct"]
BANDS = ["priority_review", "review", "monitor", "no_current_signal", "insufficient_data"]
#: Eligible rules from which coverage is broad; a fixed value, not part of a methodology.
BROAD = 6
#: Rules, or conditions of scenarios, in one long.
WORD = 62


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all(terms: list[str]) -> str:
    return "(" + " AND ".join(terms) + ")"


def _plus(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")" if terms else "0"


def prepare(features: DataFrame) -> DataFrame:
    """NaN to null, the share closed beyond eight weeks (null outside 0..1), peer counts and missing percentiles."""
    numeric = {f.name for f in features.schema.fields if f.dataType.typeName() == "double"}
    df = features.selectExpr(*[f"CASE WHEN NOT isnan({_quoted(c)}) THEN {_quoted(c)} END AS {_quoted(c)}" if c in numeric else _quoted(c) for c in features.columns])
    late = "(1 - (closed_within_3_days_pct + closed_after_3_days_within_8_weeks_pct))"
    df = df.withColumn("closed_over_8_weeks_pct", F.expr(f"CASE WHEN {late} BETWEEN 0 AND 1 THEN {late} END"))
    held = [f for f in PEER_FEATURES if f in df.columns]
    return peers.with_peers(df, PEER, [f for f in held if f"{f}_peer_percentile" not in features.columns], held)


def _ready(features: DataFrame) -> DataFrame:
    """`features` as they are where `prepare` made them, a table that methodologies share; else prepared."""
    made = {"closed_over_8_weeks_pct", *[f"{f}_peer_count" for f in PEER_FEATURES if f in features.columns]} <= set(features.columns)
    return features if made else prepare(features)


def eligible(rule: dict, m: dict) -> str:
    return _all([*[f"{_quoted(c['feature'])} IS NOT NULL" for c in rule["conditions"]], f"coalesce({_quoted(rule['peer_count_feature'])} >= {int(m['minimum_peer_size'])}, false)"])


def met(rule: dict) -> str:
    if bad := {c["operator"] for c in rule["conditions"]} - set(OPERATORS):
        raise ValueError(f"unsupported operators {sorted(bad)}")
    return _all([f"{_quoted(c['feature'])} {c['operator']} {float(c['threshold'])!r}D" for c in rule["conditions"]])


def reason(rule: dict, m: dict) -> str:
    missing = " OR ".join(f"{_quoted(c['feature'])} IS NULL" for c in rule["conditions"])
    return f"CASE WHEN {missing} THEN 'missing_required_feature' WHEN NOT {eligible(rule, m)} THEN 'peer_group_below_minimum' WHEN {met(rule)} THEN 'conditions_met' ELSE 'conditions_not_met' END"


_BEFORE = "OVER (PARTITION BY firm_key, product_group ORDER BY observation_end ASC NULLS LAST, reporting_period, source_reporting_period)"


def band(score: str, m: dict) -> str:
    whens = [f"WHEN {score} >= {int(b['minimum_score'])} THEN {_text(b['label'])}" for b in sorted(m["priority_bands"], key=lambda b: -int(b["minimum_score"]))]
    return f"CASE {' '.join(whens)} END"


def _family(rule: dict) -> str:
    return rule.get("score_family", rule["category"])


class Bits:
    """Distinct (eligible, met) conditions, each with a place in the words of the columns ok<w>, hit<w> and prior<w>."""

    def __init__(self):
        self.place: dict[tuple[str, str], int] = {}

    def of(self, m: dict) -> list[int]:
        """The place of each rule of a methodology."""
        return [self.place.setdefault((eligible(r, m), met(r)), len(self.place)) for r in m["rules"]]

    def add(self, df: DataFrame) -> DataFrame:
        """`df` with the words: of this observation, and of the one before it of the same firm and product."""
        conditions = list(self.place)
        words = {}
        for w in range(0, len(conditions), WORD):
            part = list(enumerate(conditions[w : w + WORD]))
            words[f"ok{w // WORD}"] = F.expr(" | ".join(f"CASE WHEN {e} THEN {1 << i}L ELSE 0L END" for i, (e, _) in part))
            words[f"hit{w // WORD}"] = F.expr(" | ".join(f"CASE WHEN {e} AND {t} THEN {1 << i}L ELSE 0L END" for i, (e, t) in part))
        df = df.withColumns(words)
        return df.withColumns({f"prior{w}": F.expr(f"coalesce(lag(hit{w}) {_BEFORE}, 0L)") for w in range(self.words)})

    @property
    def words(self) -> int:
        return -(-len(self.place) // WORD)

    def count(self, word: str, places: list[int]) -> str:
        """How many of the places are set; `word` is an expression with {w} for the number of the word."""
        masks: dict[int, int] = {}
        for p in places:
            masks[p // WORD] = masks.get(p // WORD, 0) | 1 << p % WORD
        return _plus([f"bit_count({word.format(w=w)} & {mask}L)" for w, mask in sorted(masks.items())])

    def is_set(self, word: str, place: int) -> str:
        return f"({word.format(w=place // WORD)} & {1 << place % WORD}L) <> 0"


_OK, _HIT, _KEPT = "ok{w}", "hit{w}", "(hit{w} & prior{w})"


def _verdict(m: dict, bits: Bits) -> dict[str, str]:
    """Summary columns as SQL over the words."""
    places = bits.of(m)
    n_ok, n_kept = bits.count(_OK, places), bits.count(_KEPT, places)
    points: dict[str, dict[int, list[int]]] = {}
    for r, p in zip(m["rules"], places):
        points.setdefault(_family(r), {}).setdefault(int(r["points"]), []).append(p)
    sums = {f: _plus([f"{n} * {bits.count(_HIT, at)}" for n, at in by.items()]) for f, by in points.items()}
    caps = m.get("family_point_caps", {})
    capped = {f: f"least({s}, {int(caps[f])})" if f in caps else s for f, s in sums.items()}
    base, bonus = _plus(list(capped.values())), f"least({n_kept}, {int(m['maximum_persistence_bonus'])})"
    least = int(m["minimum_eligible_rules_for_classification"])
    ids = [f"CASE WHEN {bits.is_set(_HIT, p)} THEN {_text(r['rule_id'])} END" for r, p in sorted(zip(m["rules"], places), key=lambda x: x[0]["rule_id"])]
    return {
        "eligible_rule_count": n_ok,
        "triggered_rule_count": bits.count(_HIT, places),
        "persistent_rule_count": n_kept,
        "triggered_rule_ids": f"concat_ws('|', {', '.join(ids)})",
        "family_scores": f"map({', '.join(f'{_text(f)}, {capped[f]}' for f in sorted(capped))})",
        "uncapped_base_warning_score": _plus(list(sums.values())),
        "base_warning_score": base,
        "point_cap_reduction": f"{_plus(list(sums.values()))} - {base}",
        "persistence_bonus": bonus,
        "warning_score": f"{base} + {bonus}",
        "coverage_status": f"CASE WHEN {n_ok} >= {BROAD} THEN 'broad' WHEN {n_ok} >= {least} THEN 'partial' ELSE 'limited' END",
        "priority_band": f"CASE WHEN {n_ok} < {least} THEN 'insufficient_data' ELSE {band(f'({base} + {bonus})', m)} END",
    }


def summary(features: DataFrame, m: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per observation: rule counts, scores, coverage and band; `carry` names feature columns to keep.

    Here and below, `features` may be what `prepare` made of them, which is how several methodologies share it.
    """
    bits = Bits()
    verdict = _verdict(m, bits)
    df = bits.add(_ready(features))
    fixed = [f"{_text(m[c])} AS {c}" for c in ("methodology_id", "methodology_status")]
    return df.selectExpr(*OBS, *carry, *[f"{e} AS {n}" for n, e in verdict.items()], *fixed)


def indicators(features: DataFrame, m: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per observation and rule, with the evidence the conditions looked at."""
    bits = Bits()
    places = bits.of(m)

    def row(rule: dict, place: int) -> str:
        evidence = ", ".join(f"{_text(c['feature'])}, cast({_quoted(c['feature'])} AS double)" for c in sorted(rule["conditions"], key=lambda c: c["feature"]))
        fields = {
            "rule_id": _text(rule["rule_id"]), "rule_label": _text(rule["label"]), "rule_category": _text(rule["category"]), "score_family": _text(_family(rule)),
            "eligible": bits.is_set(_OK, place), "triggered": bits.is_set(_HIT, place), "eligibility_reason": reason(rule, m), "peer_count": f"cast(coalesce({_quoted(rule['peer_count_feature'])}, 0) AS bigint)",
            "condition_evidence": f"map({evidence})", "base_points": f"CASE WHEN {bits.is_set(_HIT, place)} THEN {int(rule['points'])} ELSE 0 END", "persistent_trigger": bits.is_set(_KEPT, place),
        }
        return f"named_struct({', '.join(f'{_text(k)}, {v}' for k, v in fields.items())})"

    rows = bits.add(_ready(features)).selectExpr(*OBS, *carry, f"explode(array({', '.join(row(r, p) for r, p in zip(m['rules'], places))})) AS r")
    return rows.select(*OBS, *carry, "r.*")


def sensitivity(features: DataFrame, base: dict) -> DataFrame:
    """One row per scenario and observation, all scenarios in one pass.

    A scenario is a row of masks, one for all its rules and one for each family and number of points, so that the same few
    bit counts score every scenario. Scenarios share rules, points, families and caps; settings that only act on the
    verdict are told apart by the scenario's name.
    """
    runs = scenarios(base)
    bits = Bits()
    places = {name: bits.of(m) for name, m in runs}
    slots: dict[tuple[str, int], list[int]] = {}
    for i, r in enumerate(base["rules"]):
        slots.setdefault((_family(r), int(r["points"])), []).append(i)
    groups = {"every": list(range(len(base["rules"]))), **{f"slot{k}": at for k, at in enumerate(slots.values())}}
    n = range(bits.words)

    def masks(name: str) -> str:
        held = {f"{g}_{w}": sum(1 << places[name][i] % WORD for i in at if places[name][i] // WORD == w) for g, at in groups.items() for w in n}
        return f"named_struct('scenario_id', {_text(name)}, {', '.join(f'{_text(g)}, {mask}L' for g, mask in held.items())})"

    count = lambda word, group: _plus([f"bit_count({word.format(w=w)} & {group}_{w})" for w in n])
    families: dict[str, list[str]] = {}
    for k, (family, points) in enumerate(slots):
        families.setdefault(family, []).append(f"{points} * {count(_HIT, f'slot{k}')}")
    caps = base.get("family_point_caps", {})
    total = _plus([f"least({_plus(t)}, {int(caps[f])})" if f in caps else _plus(t) for f, t in families.items()])
    words = [f"{x}{w}" for w in n for x in ("ok", "hit", "prior")]
    rows = bits.add(_ready(features)).select(*OBS, *words).selectExpr("*", f"inline(array({', '.join(masks(name) for name, _ in runs)}))")
    scored = rows.selectExpr(*OBS, "scenario_id", f"{count(_OK, 'every')} AS eligible_rules", f"{count(_HIT, 'every')} AS triggered_rule_count", f"{count(_KEPT, 'every')} AS persistent_rule_count", f"{total} AS points")
    settings: dict[tuple[str, str], list[str]] = {}
    for name, m in runs:
        score = f"(points + least(persistent_rule_count, {int(m['maximum_persistence_bonus'])}))"
        label = f"CASE WHEN eligible_rules < {int(m['minimum_eligible_rules_for_classification'])} THEN 'insufficient_data' ELSE {band(score, m)} END"
        settings.setdefault((score, label), []).append(_text(name))
    pick = lambda j: "CASE " + " ".join(f"WHEN scenario_id IN ({', '.join(names)}) THEN {s[j]}" for s, names in settings.items()) + " END"
    return scored.selectExpr(*OBS, "scenario_id", "triggered_rule_count", "persistent_rule_count", f"{pick(0)} AS warning_score", f"{pick(1)} AS priority_band")


def scenario_bands(features: DataFrame, base: dict) -> DataFrame:
    """Per observation an array `runs` of (scenario_id, warning_score, priority_band), side by side: no rows are made and none is shuffled."""
    runs = scenarios(base)
    bits = Bits()
    verdicts = [_verdict(m, bits) for _, m in runs]
    # Scores and counts stand in columns of their own first, each made once; scenarios that agree share them.
    made: dict[str, str] = {}
    column = lambda e: made.setdefault(e, f"v{len(made)}")
    scores, eligible_rules = [column(v["warning_score"]) for v in verdicts], [column(v["eligible_rule_count"]) for v in verdicts]
    rows = bits.add(_ready(features)).selectExpr(*OBS, *[f"{e} AS {name}" for e, name in made.items()])
    label = lambda m, s, n: f"CASE WHEN {n} < {int(m['minimum_eligible_rules_for_classification'])} THEN 'insufficient_data' ELSE {band(s, m)} END"
    each = [f"named_struct('scenario_id', {_text(name)}, 'warning_score', {s}, 'priority_band', {label(m, s, n)})" for (name, m), s, n in zip(runs, scores, eligible_rules)]
    return rows.selectExpr(*OBS, f"array({', '.join(each)}) AS runs")


def band_stability(features: DataFrame, base: dict) -> DataFrame:
    """How each observation's band moves over the scenarios, aggregated in place on its array."""
    base_run = "filter(runs, x -> x.scenario_id = 'baseline')[0]"
    rows = scenario_bands(features, base).selectExpr("*", f"{base_run} AS b", "array_sort(array_distinct(runs.priority_band)) AS bands")
    same = "size(filter(runs, x -> x.priority_band = b.priority_band))"
    return rows.selectExpr(
        *OBS, "b.priority_band AS baseline_priority_band", "b.warning_score AS baseline_warning_score", "array_min(runs.warning_score) AS minimum_scenario_score", "array_max(runs.warning_score) AS maximum_scenario_score", "size(bands) AS distinct_scenario_bands",
        "array_join(bands, '|') AS scenario_bands", f"{same} AS scenarios_same_as_baseline", "cast(size(runs) AS bigint) AS scenario_count", f"{same} / size(runs) AS band_stability_rate",
    )


def firm_rollup(product_summary: DataFrame) -> DataFrame:
    """One row per firm and period."""
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("product_group")))), "|")
    return product_summary.groupBy("firm_key", "reporting_period").agg(
        F.count("*").alias("product_observation_count"), joined(F.col("triggered_rule_count") > 0).alias("products_with_signals"), joined(F.col("priority_band") == "priority_review").alias("products_priority_review"),
        F.max("warning_score").alias("maximum_product_warning_score"), F.sum("triggered_rule_count").alias("total_triggered_rules"), F.sum("persistent_rule_count").alias("total_persistent_rules"), F.count_if(F.col("priority_band") == "insufficient_data").alias("insufficient_data_products"),
    )
