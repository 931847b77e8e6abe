"""Rule methodologies: loading, validation, the two standard ones, and the sensitivity scenarios."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from veldspar.contracts import ContractError

OPERATORS = {">=": "__ge__", ">": "__gt__", "<=": "__le__", "<": "__lt__", "==": "__eq__"}


def load(path: str | Path) -> dict:
    return validated(json.loads(Path(path).read_text(encoding="utf-8")))


def validated(m: dict) -> dict:
    """Required fields, unique rule ids, known operators, a band that every score reaches."""
    need = {"methodology_id", "methodology_status", "minimum_peer_size", "minimum_eligible_rules_for_classification", "maximum_persistence_bonus", "priority_bands", "rules"}
    if missing := need - set(m):
        raise ContractError(f"methodology lacks {sorted(missing)}")
    ids = [r["rule_id"] for r in m["rules"]]
    if len(ids) != len(set(ids)):
        raise ContractError("rule ids repeat")
    for r in m["rules"]:
        if bad := {c["operator"] for c in r["conditions"]} - set(OPERATORS):
            raise ContractError(f"unsupported operators in {r['rule_id']}: {sorted(bad)}")
    if not any(int(b["minimum_score"]) <= 0 for b in m["priority_bands"]):
        raise ContractError("no band for a score of 0")
    return m


def _conditions(*triples):
    return [{"feature": f, "operator": o, "threshold": t} for f, o, t in triples]


def _labels(revised: bool, closed: float, large: float) -> dict[str, str]:
    """What each rule is called; the revised methodology names its support settings."""
    support = f" with at least {closed:g} closed complaints" if revised else ""
    return {
        "CTX_PROVISION_PEER_HIGH": "Provision context rate in highest peer decile",
        "CTX_INTERMEDIATION_PEER_HIGH": "Intermediation context rate in highest peer decile",
        "UPHELD_PEER_HIGH": f"Upheld percentage in highest peer decile{support}",
        "OVER_8_WEEKS_HIGH": f"At least 10% closed beyond eight weeks, upper peer quartile and at least {closed:g} closed complaints" if revised else "At least 10% closed beyond eight weeks and upper peer quartile",
        "UPHELD_DETERIORATION": f"Upheld percentage increased at least five percentage points{support}",
        "CTX_PROVISION_DETERIORATION": "Provision context rate increased at least 25%",
        "CTX_INTERMEDIATION_DETERIORATION": "Intermediation context rate increased at least 25%",
        "OPENED_VOLUME_PRESSURE": "Opened complaints increased at least 25% and are in highest peer decile",
        "OPENED_EXCEPTIONAL_GROWTH": f"Opened complaints at least doubled and current volume is at least {large:g}",
    }


def standard(revised: bool = True, closed: float = 20, large: float = 100, peers: int = 20) -> dict:
    """The revised methodology, or the first one: no family caps, no volume or denominator support, priority from 6."""
    support = [("complaints_closed_count", ">=", closed)] if revised else []
    labels = _labels(revised, closed, large)
    # Rule ids, families, points and thresholds.
    rules = [
        ("CTX_PROVISION_PEER_HIGH", "context_rate", "context_rate", 3, "context_provision_rate", [("context_provision_rate_peer_percentile", ">=", 0.9)]),
        ("CTX_INTERMEDIATION_PEER_HIGH", "context_rate", "context_rate", 3, "context_intermediation_rate", [("context_intermediation_rate_peer_percentile", ">=", 0.9)]),
        ("UPHELD_PEER_HIGH", "complaint_outcome", "complaint_outcome", 3, "complaints_upheld_pct", [*support, ("complaints_upheld_pct_peer_percentile", ">=", 0.9)]),
        ("OVER_8_WEEKS_HIGH", "timeliness", "timeliness", 3, "closed_over_8_weeks_pct", [*support, ("closed_over_8_weeks_pct", ">=", 0.1), ("closed_over_8_weeks_pct_peer_percentile", ">=", 0.75)]),
        ("UPHELD_DETERIORATION", "deterioration", "complaint_outcome", 2, "complaints_upheld_pct", [*support, ("change_complaints_upheld_pct", ">=", 0.05), ("complaints_upheld_pct_peer_percentile", ">=", 0.75)]),
        ("CTX_PROVISION_DETERIORATION", "deterioration", "context_rate", 2, "context_provision_rate", [("pct_change_context_provision_rate", ">=", 0.25), ("context_provision_rate_peer_percentile", ">=", 0.75)]),
        ("CTX_INTERMEDIATION_DETERIORATION", "deterioration", "context_rate", 2, "context_intermediation_rate", [("pct_change_context_intermediation_rate", ">=", 0.25), ("context_intermediation_rate_peer_percentile", ">=", 0.75)]),
        ("OPENED_VOLUME_PRESSURE", "volume_pressure", "volume_pressure", 1, "complaints_opened_count", [("pct_change_complaints_opened_count", ">=", 0.25), ("complaints_opened_count_peer_percentile", ">=", 0.9)]),
        ("OPENED_EXCEPTIONAL_GROWTH", "volume_pressure", "volume_pressure", 2, "complaints_opened_count", [("complaints_opened_count", ">=", large), ("pct_change_complaints_opened_count", ">=", 1.0)]),
    ]
    out = {
        "methodology_id": "panel_signals_v2" if revised else "panel_signals_v1",
        "methodology_status": "pending_business_review" if revised else "prototype",
        "minimum_peer_size": peers,
        "minimum_eligible_rules_for_classification": 3,
        "maximum_persistence_bonus": 2,
        "priority_bands": [{"minimum_score": n, "label": b} for n, b in ((8 if revised else 6, "priority_review"), (3, "review"), (1, "monitor"), (0, "no_current_signal"))],
        "rules": [
            {"rule_id": i, "label": labels[i], "category": c, "score_family": f if revised else c, "points": p, "peer_count_feature": f"{peer}_peer_count", "conditions": _conditions(*cs)}
            for i, c, f, p, peer, cs in rules[: 9 if revised else 8]
        ],
    }
    if revised:
        out["family_point_caps"] = {"context_rate": 4, "complaint_outcome": 4, "timeliness": 3, "volume_pressure": 2}
    return validated(out)


def scenarios(base: dict) -> list[tuple[str, dict]]:
    """The baseline and fourteen methodologies that each change one setting."""

    def changed(edit):
        m = copy.deepcopy(base)
        edit(m)
        return m

    def threshold(match, value):
        def edit(m):
            for r in m["rules"]:
                for c in r["conditions"]:
                    if match(c):
                        c["threshold"] = value

        return edit

    def boundary(up):
        def edit(m):
            top = max(m["priority_bands"], key=lambda b: b["minimum_score"])
            n = top["minimum_score"]
            top["minimum_score"] = n + 2 if up else max(1, n - (1 if n <= 6 else 2))

        return edit

    def setting(name, value):
        return lambda m: m.update({name: value})

    peer = lambda c: c["feature"].endswith("_peer_percentile") and c["threshold"] == 0.9
    growth = lambda c: c["feature"] in ("pct_change_context_provision_rate", "pct_change_context_intermediation_rate")
    upheld = lambda c: c["feature"] == "change_complaints_upheld_pct"
    late = lambda c: c["feature"] == "closed_over_8_weeks_pct"
    edits = [
        ("peer_high_85", threshold(peer, 0.85)), ("peer_high_95", threshold(peer, 0.95)),
        ("context_growth_20", threshold(growth, 0.2)), ("context_growth_50", threshold(growth, 0.5)),
        ("upheld_change_03", threshold(upheld, 0.03)), ("upheld_change_10", threshold(upheld, 0.1)),
        ("over_8_weeks_05", threshold(late, 0.05)), ("over_8_weeks_20", threshold(late, 0.2)),
        ("priority_lower", boundary(False)), ("priority_upper", boundary(True)),
        ("minimum_peers_10", setting("minimum_peer_size", 10)), ("minimum_peers_30", setting("minimum_peer_size", 30)),
        ("minimum_rules_2", setting("minimum_eligible_rules_for_classification", 2)), ("minimum_rules_4", setting("minimum_eligible_rules_for_classification", 4)),
    ]
    return [("baseline", copy.deepcopy(base)), *((name, changed(edit)) for name, edit in edits)]
