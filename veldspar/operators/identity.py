"""Entity resolution: exact crosswalk, ranked suggestions, review queue, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.contracts import ContractError, assert_unique, require_columns
from veldspar.functions.names import name_similarity
from veldspar.functions.semantics import comparison_key, stable_key
from veldspar.operators import shortlist as shortlist_
from veldspar.operators.closest import closest
from veldspar.store import cut


def crosswalk(observed: DataFrame, reference: DataFrame, normal) -> DataFrame:
    """Distinct (reporting_period, firm_name) resolved by unique exact name evidence; `normal` normalises a name column."""
    obs = observed.select("reporting_period", "firm_name").distinct().withColumn("name", normal(F.col("firm_name")))
    ref = reference.filter("trim(coalesce(frn, '')) <> ''").select("reporting_period", "firm_name", F.regexp_replace(F.trim("frn"), r"\.0$", "").alias("frn")).distinct()
    evidence = ref.withColumn("name", normal(F.col("firm_name"))).groupBy("name").agg(F.array_sort(F.collect_set("frn")).alias("frns"), F.array_sort(F.collect_set("reporting_period")).alias("periods"), F.count("*").alias("rows"))
    j = obs.join(evidence, "name", "left")
    n = F.coalesce(F.size("frns"), F.lit(0))
    n = F.when(F.col("frns").isNull(), 0).otherwise(n)
    same = F.array_contains("periods", F.col("reporting_period"))
    return j.select(
        "reporting_period", "firm_name",
        F.when(n == 1, F.col("frns")[0]).otherwise("").alias("resolved_frn"),
        F.when(n == 0, "unmatched").when(n > 1, "ambiguous").otherwise("matched").alias("match_status"),
        F.when(n == 0, "no_exact_legal_name_reference").when(n > 1, "exact_name_multiple_frns").when(same, "exact_name_same_period").otherwise("exact_name_global_unique").alias("match_method"),
        F.when(n != 1, "none").when(same, "high").otherwise("medium").alias("match_confidence"),
        n.cast("int").alias("candidate_frn_count"), F.coalesce(F.array_join("frns", "|"), F.lit("")).alias("candidate_frns"), F.coalesce(F.array_join("periods", "|"), F.lit("")).alias("evidence_periods"), F.coalesce("rows", F.lit(0)).alias("evidence_rows"),
    )


def candidates(aliases: DataFrame) -> DataFrame:
    """Legal and trading names backed by an identifier, with their evidence."""
    src = aliases.filter("trim(coalesce(frn, '')) <> ''").withColumn("frn", F.regexp_replace(F.trim("frn"), r"\.0$", ""))
    legal = src.select(F.trim("firm_name").alias("candidate_name"), F.col("firm_name").alias("candidate_legal_name"), F.lit("legal_name").alias("candidate_name_type"), "frn", "reporting_period")
    trading = src.filter("trim(coalesce(trading_name, '')) <> ''").select(F.trim("trading_name").alias("candidate_name"), F.col("firm_name").alias("candidate_legal_name"), F.lit("trading_name").alias("candidate_name_type"), "frn", "reporting_period")
    both = legal.unionByName(trading).filter("candidate_name <> ''")
    return both.groupBy("candidate_name", "candidate_legal_name", "candidate_name_type", "frn").agg(F.array_join(F.array_sort(F.collect_set("reporting_period")), "|").alias("evidence_periods"), F.count("*").alias("evidence_rows"))


def _shortlisted(names: DataFrame, cand: DataFrame, tie: list[str], most: int) -> DataFrame:
    """(key, cid, s): the `most` best of each key by word overlap and length, with their similarity."""
    keys = cut(names.filter("key IS NOT NULL").select(F.col("key").alias("name"), "key").distinct(), "suggest-keys")
    found = shortlist_.candidates_for(keys, cand.select("cid", F.col("ckey").alias("key"), *tie), tie, most)
    pairs = found.withColumnRenamed("name", "key").join(cand.select("cid", "ckey", *tie), "cid")
    own, other = shortlist_.words(F.col("key")), shortlist_.words(F.col("ckey"))
    score = shortlist_.rough(F.size(F.array_intersect(own, other)), F.size(own), F.size(other), F.length("key"), F.length("ckey"))
    short = pairs.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc(score), *tie))).filter(F.col("r") <= most)
    return cut(short.select("key", "cid", name_similarity("key", "ckey").alias("s")), "suggest-scored")


def suggest(unmatched: DataFrame, aliases: DataFrame, normal, per_firm: int = 3, shortlist: int | None = None) -> DataFrame:
    """Up to `per_firm` candidates of distinct identifiers for each unmatched name, the most similar of all candidates, see `closest`.

    Comparison keys are compared once, not for each name and period. With a `shortlist`, similarity sees only so many candidates of each name,
    the best by word overlap and length, see `shortlist`; it may leave out candidates that are more similar.
    """
    tie = ["candidate_name", "frn", "candidate_name_type", "candidate_legal_name"]
    names = cut(unmatched.select("firm_name").distinct().withColumn("key", comparison_key(normal(F.col("firm_name")))), "suggest-names")
    cand = candidates(aliases).withColumn("ckey", comparison_key(normal(F.col("candidate_name"))))
    cand = cut(cand.withColumn("cid", F.monotonically_increasing_id()), "suggest-candidates")
    scored = closest(names, cand, tie, per_firm) if shortlist is None else _shortlisted(names, cand, tie, shortlist)
    top = scored.join(cand, "cid").drop("cid")
    best = [F.desc("s.combined"), F.desc("s.character"), *[F.col(c) for c in tie]]
    once = top.withColumn("r", F.row_number().over(W.partitionBy("key", "frn").orderBy(*best))).filter("r = 1")
    ranked = once.withColumn("suggestion_rank", F.row_number().over(W.partitionBy("key").orderBy(*best))).filter(F.col("suggestion_rank") <= per_firm)
    ranked = names.join(ranked, "key")
    out = unmatched.select("reporting_period", "firm_name").distinct().join(ranked, "firm_name")
    # Limits of similarity, and words of status.
    quality = F.when(F.col("s.combined") >= 0.9, "high_similarity").when(F.col("s.combined") >= 0.75, "medium_similarity").otherwise("low_similarity")
    return out.select(
        stable_key("MATCH", F.col("reporting_period"), F.col("firm_name"), F.col("candidate_name"), F.col("frn"), length=12).alias("suggestion_id"), "reporting_period", F.col("firm_name").alias("unmatched_firm_name"), "suggestion_rank",
        "candidate_name", "candidate_legal_name", "candidate_name_type", F.col("frn").alias("candidate_frn"), F.col("s.character").alias("character_similarity"), F.col("s.token").alias("token_similarity"), F.col("s.combined").alias("combined_score"),
        quality.alias("suggestion_quality"), "evidence_periods", "evidence_rows", (F.col("key") == F.col("ckey")).alias("exact_comparison_key"), F.lit("pending_review").alias("review_status"),
    )


def review_queue(suggestions: DataFrame) -> DataFrame:
    """One row per unmatched name: its most frequent top candidate and a tier."""
    top = suggestions.filter("suggestion_rank = 1")
    each = top.groupBy("unmatched_firm_name", "candidate_frn", "candidate_name", "candidate_legal_name", "candidate_name_type").agg(F.count("*").alias("n"), F.min("reporting_period").alias("seen"), F.every("exact_comparison_key").alias("exact"), F.max("combined_score").alias("top_combined_score"))
    pick = each.withColumn("r", F.row_number().over(W.partitionBy("unmatched_firm_name").orderBy(F.desc("n"), "seen", "candidate_frn", "candidate_name"))).filter("r = 1").drop("r", "n", "seen")
    span = top.groupBy("unmatched_firm_name").agg(F.array_join(F.array_sort(F.collect_set("reporting_period")), "|").alias("affected_reporting_periods"), F.count_distinct("reporting_period").alias("affected_period_count"), (F.count_distinct("candidate_frn") == 1).alias("top_candidate_consistent_across_periods"))
    tier = F.when(F.col("exact"), "A").when(F.col("top_combined_score") >= 0.9, "B").when(F.col("top_combined_score") >= 0.75, "C").otherwise("D")
    action = {"A": "confirm_legal_identity_then_approve", "B": "investigate_name_difference", "C": "seek_authoritative_rename_or_trading_name_evidence", "D": "leave_unmatched_unless_new_evidence_found"}
    actions = F.create_map(*[F.lit(x) for kv in action.items() for x in kv])
    return pick.join(span, "unmatched_firm_name").withColumn("priority_tier", tier).withColumn("recommended_action", actions[F.col("priority_tier")])


def keyed_update(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`target` with `columns` replaced where `updates` has the key; every update must hit exactly one row."""
    assert_unique(updates, keys)
    hits = updates.select(*keys).join(target.groupBy(*keys).count(), keys, "left").filter("coalesce(count, 0) <> 1")
    if bad := hits.limit(1).collect():
        raise ContractError(f"update does not hit exactly one row: {bad[0].asDict()}")
    u = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    j = target.join(u, keys, "left")
    return j.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def apply_decisions(suggestions: DataFrame, decisions: DataFrame, walk: DataFrame) -> DataFrame:
    """The crosswalk with approved suggestions applied; everything else stays."""
    require_columns(decisions, ["suggestion_id", "decision", "reviewer", "reviewed_at", "reviewer_comment"])
    assert_unique(decisions, ["suggestion_id"])
    if decisions.filter("decision NOT IN ('approved', 'rejected', 'unresolved')").head(1):
        raise ContractError("invalid decisions")
    if decisions.join(suggestions, "suggestion_id", "left_anti").head(1):
        raise ContractError("decisions reference unknown suggestions")
    if decisions.filter("decision = 'approved' AND (coalesce(reviewer, '') = '' OR coalesce(reviewed_at, '') = '')").head(1):
        raise ContractError("approved decisions need reviewer and date")
    ok = suggestions.join(decisions.filter("decision = 'approved'").select("suggestion_id"), "suggestion_id", "left_semi")
    keys = ["reporting_period", "firm_name"]
    up = ok.select("reporting_period", F.col("unmatched_firm_name").alias("firm_name"), F.col("candidate_frn").alias("resolved_frn"), F.lit("matched").alias("match_status"), F.lit("manually_approved_name_variant").alias("match_method"), F.lit("reviewed").alias("match_confidence"), F.lit(1).alias("candidate_frn_count"), F.col("candidate_frn").alias("candidate_frns"), "evidence_periods", "evidence_rows")
    if up.groupBy(*keys).count().filter("count > 1").head(1):
        raise ContractError("More than one candidate is approved for an observation")
    return keyed_update(walk, up, keys, [c for c in up.columns if c not in keys])
