"""Scalar and window expressions with the exact semantics the panel engine is defined by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def nan_to_null(c: Column) -> Column:
    """NaN would satisfy every >= in Spark; absence is null everywhere here."""
    return F.when(~F.isnan(c), c)


def try_number(c: Column) -> Column:
    """Number of a text, else null; a suffix as in '5d' or the words nan and Infinity are no numbers."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.when(b.isNotNull() & (b != 0), a / b)


def pct_rank_avg(value: str, *group: str) -> Column:
    """Average-tie percentile rank: (rank + (ties - 1) / 2) / non-null count; null stays null. One sort for each value."""
    v = F.col(value)
    whole = W.partitionBy(*group)
    order = whole.orderBy(v.asc_nulls_last())
    ties = F.count(v).over(order.rangeBetween(0, 0))
    return F.when(v.isNotNull(), (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / F.count(v).over(whole))


def half_year(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-H"), F.when(F.month(date) <= 6, "1").otherwise("2"))


def period_start(period: Column) -> Column:
    return F.make_date(F.substring(period, 1, 4).cast("int"), F.when(period.endswith("H1"), 1).otherwise(7), F.lit(1))


def period_end(period: Column) -> Column:
    return F.last_day(F.add_months(period_start(period), 5))


def periods_between(first: Column, last: Column) -> Column:
    """Array of all half-years from one to another."""
    return F.transform(F.sequence(period_start(first), period_start(last), F.expr("interval 6 months")), half_year)


def window_bounds(text: Column) -> tuple[Column, Column]:
    """Start and end of 'A to B', with dates as yyyy-MM-dd or dd-MM-yyyy; null where they don't parse."""
    parts = F.split(F.trim(text), " to ", 2)

    def parse(i: int) -> Column:
        p = F.trim(F.get(parts, F.lit(i)))
        return F.when(F.size(parts) == 2, F.when(p.rlike("^[0-9]{4}"), F.try_to_date(p, "yyyy-MM-dd")).otherwise(F.try_to_date(p, "dd-MM-yyyy")))

    return parse(0), parse(1)


def day_month_year2(text: Column) -> Column:
    """'dd MMM yy' with years from 69 in the 1900s."""
    d = F.try_to_date(text, "dd MMM yy")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def stable_key(prefix: str, *parts: Column, length: int = 16, algorithm: str = "sha256") -> Column:
    """PREFIX-<upper-case hash prefix> of the parts joined by '|'; null parts count as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digest = F.sha2(text, 256) if algorithm == "sha256" else F.sha1(text)
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(digest, 1, length)))


def collapse(c: Column) -> Column:
    """Strip and collapse all Unicode white space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def normalise_text(c: Column) -> Column:
    return F.lower(collapse(c))


def strip_qualifier(c: Column) -> Column:
    """Label without a trailing parenthesised qualifier."""
    return F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")


#: Legal forms that compare equal, longest first.
LEGAL_FORMS = [("public limited company", "plc"), ("incorporated", "inc"), ("corporation", "corp"), ("limited", "ltd")]


def comparison_key(c: Column) -> Column:
    """Loose key of an (already case-folded) name: '&' as 'and', no punctuation, legal forms unified."""
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), r"(?U)[^\w\s]", " ")
    c = collapse(c)
    for phrase, short in LEGAL_FORMS:
        c = F.regexp_replace(c, rf"\b{phrase}\b", short)
    return collapse(c)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def metric_value(text: Column) -> Column:
    """Struct (value, status, reason) of a metric cell given as text; absence never becomes zero."""
    t = collapse(text)
    cleaned = F.replace(F.replace(t, F.lit(",")), F.lit("%"))
    number = try_number(cleaned)
    value = F.when(t.endswith("%"), number / 100).otherwise(number)
    out = lambda v, s, r: F.struct(v.cast("double").alias("value"), F.lit(s).alias("status"), F.lit(r).alias("reason"))
    none = F.lit(None)
    return (
        F.when(text.isNull() | (t == ""), out(none, "missing", "blank_source_cell"))
        .when(F.lower(t).isin("null", "n/a", "na", "-"), out(none, "missing_marker", "source_missing_literal"))
        .when(t.startswith("#"), out(none, "invalid", "excel_error"))
        .when(F.lower(t).isin("true", "false"), out(none, "invalid", "boolean_in_metric_cell"))
        .when(number.isNotNull(), out(value, "valid", ""))
        .otherwise(out(none, "invalid", "non_numeric_metric_value"))
    )


def first_keyword(text: Column, classes: list[tuple[str, str, list[str]]], default: tuple[str, str]) -> Column:
    """Struct (label, basis) of the first class one of whose terms the lower-cased text contains."""
    low, out = F.lower(text), None
    for label, basis, terms in classes:
        hit = F.greatest(*[low.contains(t) for t in terms]) if len(terms) > 1 else low.contains(terms[0])
        pair = F.struct(F.lit(label).alias("label"), F.lit(basis).alias("basis"))
        out = F.when(hit, pair) if out is None else out.when(hit, pair)
    return out.otherwise(F.struct(F.lit(default[0]).alias("label"), F.lit(default[1]).alias("basis")))
