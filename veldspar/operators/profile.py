"""Profiling: column profiles, header candidates, hierarchy fill, schema differences, review gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions.semantics import normalise_text, stable_key, try_number
from veldspar.plans.scan import scan

#: Markers of absence in text cells.
MISSING = ("-", "--", "—", "–", "missing", "null", "none")
SUPPRESSED = ("*", "**", "[x]", "suppressed", "not published")
NOT_APPLICABLE = ("n/a", "na", "n.a.", "not applicable", "not_applicable")
ERRORS = ("#div/0!", "#n/a", "#name?", "#null!", "#num!", "#ref!", "#value!")


def text_marker(c: Column) -> Column:
    """blank, missing_marker, suppressed, not_applicable, excel_error, or null for a substantive text."""
    t = normalise_text(c)
    return F.when(t == "", "blank").when(t.isin(*MISSING), "missing_marker").when(t.isin(*SUPPRESSED), "suppressed").when(t.isin(*NOT_APPLICABLE), "not_applicable").when(t.isin(*ERRORS) | t.rlike(r"^#.*[!?]$"), "excel_error")


_KINDS = {"string": "text", "boolean": "boolean", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: counts, distinct values, extremes, what parses as number; all columns in one pass."""
    aggs: list[Column] = []
    for c, t in df.dtypes:
        col, number = F.col(f"`{c}`"), t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")
        kind = "numeric" if number else _KINDS.get(t, "other")
        marker = text_marker(col) if kind == "text" else F.lit(None).cast("string")
        value = col.cast("double") if number else F.lit(None).cast("double")
        parsed = F.count_if(marker.isNull() & try_number(col).isNotNull()) if kind == "text" else F.lit(0).cast("long")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count("*").alias("row_count"), F.count_if(col.isNull()).alias("null_count"), F.count_distinct(col).alias("distinct_count"),
                F.count_if(marker.isNotNull()).alias("marker_count"), F.count_if(value == 0).alias("zero_count"), F.count_if(value < 0).alias("negative_count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"),
                F.count_if(value != F.floor(value)).alias("fraction_count"), parsed.alias("parsed_count"),
            ).alias(f"p{len(aggs)}")
        )
    return df.agg(*aggs).select(F.explode(F.array(*[f"p{i}" for i in range(len(aggs))])).alias("p")).select("p.*")


def semantic_type(p: DataFrame, identifiers: tuple[str, ...] = ()) -> DataFrame:
    """Type of a profiled column, first match wins; `identifiers` are headers of identifying columns. Columns have one kind
    here, so that none is mixed; for cells see `worksheets.value_profile`."""
    filled, name, kind = F.col("row_count") - F.col("null_count") - F.col("marker_count"), normalise_text(F.col("column")), F.col("kind")
    whole = F.col("fraction_count") == 0
    return p.withColumn(
        "semantic_type",
        F.when(filled == 0, "empty").when(name.isin(*identifiers), "identifier").when(name.contains("percentage"), "percentage").when(name.contains("redress"), "currency").when(kind.isin("date", "boolean"), kind)
        .when((kind == "numeric") & whole, "integer_like").when(kind == "numeric", "decimal_like").when((kind == "text") & (F.col("parsed_count") == filled), "numeric_text").otherwise(kind),
    )


def header_candidates(cells: DataFrame, group: list[str], terms: list[str] | dict[str, tuple[str, ...]], scan_rows: int = 40) -> DataFrame:
    """Rank of early rows as header, from cells (*group, row, col, kind, value): density, keywords, uniqueness, text, neighbours.

    `terms` may differ by a sheet's type; cells then carry sheet_type, and a type without terms has those of the first.
    """
    filled = cells.filter("trim(coalesce(value, '')) <> ''").withColumn("norm", normalise_text(F.col("value")))
    holds = lambda some: reduce(lambda a, b: a | b, [F.col("norm").contains(t) for t in some])
    if isinstance(terms, dict):
        hit = reduce(lambda chain, kind: chain.when(F.col("sheet_type") == kind, holds(terms[kind])), list(terms)[1:], F.when(F.lit(False), False)).otherwise(holds(next(iter(terms.values()))))
    else:
        hit = holds(terms)
    per = filled.groupBy(*group, "row").agg(F.count("*").alias("n"), F.count_if(hit).alias("keywords"), F.count_distinct("norm").alias("distinct"), F.count_if(F.col("kind") == "text").alias("texts"), F.count_if(F.col("kind") == "numeric").alias("numbers"))
    by_row = W.partitionBy(*group).orderBy("row")
    following = F.when(F.lead("row").over(by_row) == F.col("row") + 1, F.lead("n").over(by_row)).otherwise(0)
    # Weights of the parts of a header's score.
    score = F.col("n") * 1.5 + F.col("keywords") * 2.0 + F.col("distinct") / F.col("n") * 2.0 + F.col("texts") / F.col("n") - F.col("numbers") / F.col("n") + F.least(following / F.col("n"), F.lit(1.0))
    scored = per.withColumn("score", F.round(score, 4)).filter(F.col("row") <= scan_rows)
    order = W.partitionBy(*group).orderBy(F.desc("score"), "row")
    out = scored.withColumns({"candidate_rank": F.row_number().over(order), "runner_up_score": F.lead("score").over(order)}).withColumn("score_margin", F.round(F.col("score") - F.col("runner_up_score"), 4))
    wide = lambda m: F.col("score_margin").isNull() | (F.col("score_margin") >= m)
    conf = F.when((F.col("keywords") >= 2) & wide(2), "high").when((F.col("keywords") >= 1) & wide(1), "medium").otherwise("low")
    return out.withColumn("header_confidence", F.when(F.col("candidate_rank") == 1, conf))


def fill_down(df: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """Blank cells inherit the last filled one above; one sheet may lie in many tasks."""
    return scan(df, group, [order], lasts={f"inherited_{c}": F.when(F.trim(c) != "", F.col(c)) for c in columns}, name="filled")


def number_in_section(df: DataFrame, group: list[str], order: str, is_heading: Column) -> DataFrame:
    """Section number, and the row's number inside its section: its distance to the section's heading in rows of the group."""
    rows = df.withColumn("__heading", F.coalesce(is_heading, F.lit(False)))
    at = scan(rows, group, [order], sums={"section_number": F.when(F.col("__heading"), 1).otherwise(0), "__at": F.lit(1)}, name="sections", dealt=True)
    began = scan(at, group, [order], lasts={"__began": F.when(F.col("__heading"), F.col("__at"))})
    return began.withColumn("sequence", (F.col("__at") - F.coalesce("__began", F.lit(1)) + 1).cast("int")).drop("__heading", "__at", "__began")


def suffix_duplicates(df: DataFrame, group: list[str], name: str, order: str) -> DataFrame:
    """Second and later occurrences of a name get _2, _3, ..."""
    n = F.row_number().over(W.partitionBy(*group, name).orderBy(order))
    return df.withColumn("unique_name", F.when(n > 1, F.concat(F.col(name), F.lit("_"), n.cast("string"))).otherwise(F.col(name)))


def consecutive_changes(df: DataFrame, period: str, keys: list[str], values: list[str]) -> DataFrame:
    """Keys added, removed or changed between consecutive periods: one full outer join on (ordinal, key)."""
    ordinals = df.select(period).distinct().withColumn("ordinal", F.dense_rank().over(W.orderBy(period)))  # a row per period
    last = ordinals.agg(F.max("ordinal")).first()[0] or 0
    d = df.join(F.broadcast(ordinals), period)
    new = d.filter("ordinal > 1").select("ordinal", *keys, *[F.col(v).alias(f"current_{v}") for v in values], F.lit(True).alias("__new"))
    old = d.filter(F.col("ordinal") < last).select((F.col("ordinal") + 1).alias("ordinal"), *keys, *[F.col(v).alias(f"previous_{v}") for v in values], F.lit(True).alias("__old"))
    j = old.join(new, ["ordinal", *keys], "full_outer")
    differs = reduce(lambda a, b: a | b, [~F.col(f"previous_{v}").eqNullSafe(F.col(f"current_{v}")) for v in values])
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(differs, "changed")
    names = ordinals.select(F.col("ordinal"), F.col(period).alias("current_period"))
    return j.withColumn("change_type", change).filter("change_type IS NOT NULL").join(F.broadcast(names), "ordinal").drop("__old", "__new", "ordinal")


def review_items(findings: DataFrame) -> DataFrame:
    """Findings (category, scope, issue, severity, blocks) with stable ids."""
    return findings.withColumn("review_item_id", stable_key("REV", F.col("category"), F.col("scope"), F.col("issue"), length=10))


def gate(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: sign-off status over blocking items; nothing is approved by default."""
    j = items.join(decisions.select("review_item_id", "decision"), "review_item_id", "left")
    status = F.when(F.col("decision").startswith("approve"), "approved").when(F.col("decision") == "rejected", "rejected").otherwise("pending_review")
    b = j.withColumn("s", status).filter("blocks").agg(F.count("*").alias("blocking_items"), F.count_if(F.col("s") == "pending_review").alias("pending_items"), F.count_if(F.col("s") == "rejected").alias("rejected_items"), F.count_if(F.col("s") == "approved").alias("approved_items"))
    return b.withColumn("review_status", F.when(F.col("rejected_items") > 0, "rejected").when(F.col("pending_items") > 0, "awaiting_manual_review").otherwise("approved")).withColumn("extraction_authorised", F.col("review_status") == "approved")
