"""Action registers and release gates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.contracts import ContractError, issues, require_columns
from veldspar.sources.files import markdown

STATUSES = ("not_started", "in_progress", "blocked", "completed", "rejected")
APPROVALS = ("pending_business_review", "approved", "rejected")


def iso_date(c: Column) -> Column:
    """Empty or a date as yyyy-MM-dd."""
    return (F.coalesce(c, F.lit("")) == "") | F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def register_issues(register: DataFrame) -> DataFrame:
    """Violations of an action register: repeated ids, unknown states, final states or approvals without metadata, bad dates."""
    require_columns(register, ["action_id", "status", "approval_status", "approved_by", "approved_at", "completed_at"])
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    repeated = register.groupBy("action_id").count().filter("count > 1").select(F.lit("error").alias("severity"), F.lit("unique_action_id").alias("rule"), "count")
    return issues(
        register,
        {
            "known_status": F.col("status").isin(*STATUSES),
            "known_approval": F.col("approval_status").isin(*APPROVALS),
            "final_has_date": ~F.col("status").isin("completed", "rejected") | filled("completed_at"),
            "approval_has_metadata": (F.col("approval_status") != "approved") | (filled("approved_by") & filled("approved_at")),
            "iso_dates": iso_date(F.col("approved_at")) & iso_date(F.col("completed_at")),
        },
    ).unionByName(repeated)


def load_register(register: DataFrame) -> DataFrame:
    if bad := register_issues(register).collect():
        raise ContractError(str([r.asDict() for r in bad]))
    return register


def release_gate(register: DataFrame, methodology_status: str) -> DataFrame:
    """One row: ready only if nothing is open and the methodology is approved."""
    g = register.agg(F.count("*").alias("actions"), F.count_if(~F.col("status").isin("completed", "rejected")).alias("open_actions"), F.count_if(F.col("approval_status") == "approved").alias("approved_actions"))
    return g.withColumn("release_ready", (F.col("open_actions") == 0) & (F.col("approved_actions") == F.col("actions")) & F.lit(methodology_status == "approved"))


def coverage(periods: DataFrame, expected: list[str]) -> DataFrame:
    """Missing, unexpected and repeated periods."""
    want = periods.sparkSession.createDataFrame([(p,) for p in expected], "reporting_period string")
    seen = periods.groupBy("reporting_period").count()
    j = want.withColumn("w", F.lit(True)).join(seen, "reporting_period", "full_outer")
    status = F.when(F.col("w").isNull(), "unexpected").when(F.col("count").isNull(), "missing").when(F.col("count") > 1, "repeated")
    return j.select("reporting_period", status.alias("status")).filter("status IS NOT NULL")


def counts(column: str, values: tuple[str, ...]) -> Column:
    """Map of the given values to how often they occur, in one pass with other aggregates."""
    return F.create_map(*[x for v in values for x in (F.lit(v), F.count_if(F.col(column) == v))])


def register_summary(register: DataFrame, methodology_action: str) -> DataFrame:
    """One row: actions, open ones, open ones without an owner, pending approvals, counts by state, and whether the methodology's action is approved."""
    open_ = ~F.col("status").isin("completed", "rejected")
    return register.agg(
        F.count("*").alias("action_count"), F.count_if(open_).alias("open_action_count"), F.count_if(open_ & (F.coalesce(F.trim("owner"), F.lit("")) == "")).alias("unassigned_open_action_count"), F.count_if(F.col("approval_status") == "pending_business_review").alias("pending_approval_count"),
        counts("status", STATUSES).alias("status_counts"), counts("approval_status", APPROVALS).alias("approval_status_counts"), (F.count_if((F.col("action_id") == methodology_action) & (F.col("approval_status") == "approved")) > 0).alias("methodology_approved"),
    )


def handoff_gate(register: DataFrame, evidence: DataFrame, methodology_action: str, deciding: list[str]) -> DataFrame:
    """One row: release is authorised only with the methodology approved, every cited reference known to `evidence`
    (evidence_reference), and no decision of the `deciding` actions pending."""
    cited = register.filter("trim(coalesce(evidence_reference, '')) <> ''").select("action_id", "evidence_reference")
    lost = cited.join(evidence.select("evidence_reference").distinct(), "evidence_reference", "left_anti")
    missing = lost.agg(F.array_sort(F.collect_list(F.concat_ws(":", "action_id", "evidence_reference"))).alias("missing_evidence_references"))  # registers are kept by hand
    pending = F.count_if(F.col("action_id").isin(deciding) & ~F.col("approval_status").isin("approved", "rejected"))
    g = register_summary(register, methodology_action).crossJoin(register.agg(pending.alias("pending_decision_count"))).crossJoin(missing)  # one row each
    ready = F.col("methodology_approved") & (F.size("missing_evidence_references") == 0) & (F.col("pending_decision_count") == 0)
    return g.withColumn("release_authorised", ready)


def report(register: DataFrame, methodology_action: str) -> str:
    """Status of the register as Markdown: the gate, all actions, and what is to be decided next."""
    s = register_summary(load_register(register), methodology_action).first()
    lines = ["# Action register", "", *[f"- {k.replace('_', ' ')}: **{s[k]}**" for k in ("action_count", "open_action_count", "unassigned_open_action_count", "pending_approval_count", "methodology_approved")]]
    lines += ["", markdown(register.orderBy("action_id")), "", "## Open", ""]
    rows = register.filter("status NOT IN ('completed', 'rejected')").orderBy("action_id").select("action_id", "action_title").collect()
    return "\n".join([*lines, *([f"- {r['action_id']}: {r['action_title']}" for r in rows] or ["- nothing"])]) + "\n"


def handoff(register: DataFrame, evidence: DataFrame, methodology_action: str, deciding: list[str]) -> tuple[str, str]:
    """The gate as JSON, and an agenda as Markdown."""
    gate = handoff_gate(load_register(register), evidence, methodology_action, deciding).first().asDict(recursive=True)
    lines = ["# Review handoff", "", f"Release is {'authorised' if gate['release_authorised'] else 'not authorised'}.", ""]
    for r in register.orderBy("action_id").collect():
        lines += [f"## {r['action_id']}: {r['action_title']}", "", *[f"- {c.replace('_', ' ')}: {r[c]}" for c in ("status", "approval_status", "owner", "evidence_reference")], ""]
    return json.dumps(gate, indent=2, sort_keys=True), "\n".join(lines) + "\n"


def manifest(name: str, notice: str, dashboards: dict[str, list[DataFrame | str]], prohibited: list[str]) -> str:
    """What a dashboard tool needs to know, as JSON: sources of each dashboard, with their columns where a table is given."""
    source = lambda x: x if isinstance(x, str) else {c: t for c, t in x.dtypes}
    return json.dumps({"workbook_name": name, "notice": notice, "dashboards": [{"name": n, "sources": [source(x) for x in xs]} for n, xs in dashboards.items()], "prohibited": prohibited}, indent=2, sort_keys=True)


def summary_json(one: DataFrame) -> str:
    """A result of one row, maps included, as JSON."""
    rows = one.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ContractError("a summary has one row")
    return json.dumps(json.loads(rows[0]), indent=2, sort_keys=True)


def snapshot(methodology: dict, source: str) -> str:
    """A methodology as it was run, with where it came from, as JSON."""
    return json.dumps({"source": source, "methodology": methodology}, indent=2, sort_keys=True)
