"""Peer statistics whose groups may be of any size: average-tie percentile ranks, peer counts and exact quantiles.

A group of ordinary size is ranked by a window: one exchange for all features. A group of more than HOT rows would be one task
and one sort for each feature; such groups, of which there are fewer than rows / HOT, take a two-level rank instead: their
distinct values are counted, these counts are summed along ranges of (group, feature, value), see `scan`, and joined back to the rows by
value. Quantiles of a group of more than BUFFERED rows come from the same running counts: the rows whose counts cover a rank are
the order statistics, so that no buffer holds more than so many values. Both ways give the same rows.

Null values take no part and have no rank; null group keys are a group like others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions.semantics import pct_rank_avg
from veldspar.plans.scan import ranged, scan
from veldspar.store import BROADCAST_BYTES, cut, settled, size

#: Rows from which a group is ranked by its distinct values (a window sorts whole rows once for each feature, and a task holds several
#: groups and sorts at a time), and from which its quantiles are, instead of a buffer of its values.
HOT, BUFFERED = 20_000, 100_000
#: Most bytes of all ranks by value that are broadcast, as `size` counts them.
SHARES = BROADCAST_BYTES


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`a` and `b` joined where all keys are equal or both null; the keys stay once."""
    other = {k: f"__k{i}" for i, k in enumerate(keys)}
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    return a.join(b.withColumnsRenamed(other), on, how).drop(*other.values())


def _values(df: DataFrame, group: list[str], features: list[str], *carry: str) -> DataFrame:
    """(*group, *carry, feature, value): a row for each feature, by its number, that isn't null."""
    each = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    return df.select(*group, *carry, F.explode(each).alias("__x")).select(*group, *carry, "__x.feature", "__x.value").filter("value IS NOT NULL")


def running_counts(df: DataFrame, group: list[str], features: list[str], parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): (*group, feature, value, n, upto), distinct values with how many rows have each, and how many have it or
    a lesser one; (*group, feature, total)."""
    counted = _values(df, group, features).groupBy(*group, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    keys = [*group, "feature"]
    dealt = ranged(counted, keys, ["value"], "peer-values", parts)
    return scan(dealt, keys, ["value"], sums={"upto": F.col("n")}), dealt.groupBy(*keys).agg(F.sum("n").alias("total"))


def _hot(df: DataFrame, group: list[str], hot: int) -> DataFrame | None:
    """The keys of groups of more than `hot` rows, fewer than there are rows by that factor; None where there are none."""
    large = cut(df.groupBy(*group).count().filter(F.col("count") > hot).select(*group), "peer-groups")
    return large if large.head(1) else None


def _windowed(df: DataFrame, group: list[str], ranks: list[str], counts: list[str]) -> DataFrame:
    return df.withColumns({f"{f}_peer_count": F.count(f).over(W.partitionBy(*group)) for f in counts} | {f"{f}_peer_percentile": pct_rank_avg(f, *group) for f in ranks})


def _ranged(df: DataFrame, group: list[str], ranks: list[str], counts: list[str], parts: int | None) -> DataFrame:
    """The same columns for hot groups: `df` has no others, so totals are bounded by their number.

    Ranks go back to the rows by value. Where the table of distinct values is small, as measured, rows aren't shuffled for it.
    """
    features = list(dict.fromkeys([*ranks, *counts]))
    found, total = running_counts(df, group, features, parts)
    total = cut(total, "peer-totals")
    rank = F.col("upto") - F.col("n") + 1
    share = _met(found, F.broadcast(total), [*group, "feature"]).select(*group, "feature", "value", ((rank + (F.col("n") - 1) / F.lit(2.0)) / F.col("total")).alias("share"))
    share = cut(share, "peer-shares")
    if size(share) <= SHARES:
        out = df
        for f in ranks:
            of = share.filter(F.col("feature") == features.index(f)).select(*group, F.col("value").alias("__value"), F.col("share").alias(f"{f}_peer_percentile"))
            out = _met(out.withColumn("__value", F.col(f).cast("double")), F.broadcast(of), [*group, "__value"], "left").drop("__value")
    else:
        rows = cut(df.withColumn("__row", F.monotonically_increasing_id()), "peer-hot")
        met = _met(_values(rows, group, ranks, "__row"), share.hint("merge"), [*group, "feature", "value"])
        wide = met.groupBy("__row").agg(*[F.max(F.when(F.col("feature") == features.index(f), F.col("share"))).alias(f"{f}_peer_percentile") for f in ranks])
        out = rows.join(wide.hint("merge"), "__row", "left").drop("__row")
    if not counts:
        return out
    each = total.groupBy(*group).agg(*[F.coalesce(F.max(F.when(F.col("feature") == features.index(f), F.col("total"))), F.lit(0)).alias(f"{f}_peer_count") for f in counts])
    return _met(out, F.broadcast(each), group, "left").na.fill(0, [f"{f}_peer_count" for f in counts])


def with_peers(df: DataFrame, group: list[str], ranks: list[str], counts: list[str] = (), hot: int = HOT, parts: int | None = None) -> DataFrame:
    """`df` with <feature>_peer_percentile for `ranks` and <feature>_peer_count for `counts`, among the rows of the same `group`."""
    df = settled(df, "peer-rows")
    large = _hot(df, group, hot)
    if large is None:
        return _windowed(df, group, list(ranks), list(counts))
    rest = _met(df, F.broadcast(large), group, "left_anti")
    many = _met(df, F.broadcast(cut(large.withColumn("__group", F.monotonically_increasing_id()), "peer-numbers")), group)  # a number is shorter than a key
    added = [*[f"{f}_peer_count" for f in counts], *[f"{f}_peer_percentile" for f in ranks]]
    columns = [*df.columns, *added]
    return _windowed(rest, group, list(ranks), list(counts)).select(columns).unionByName(_ranged(many, ["__group"], list(ranks), list(counts), parts).select(columns))


def _order_statistics(df: DataFrame, group: list[str], features: list[str], at: dict[str, float], parts: int | None) -> DataFrame:
    """Quantiles from running counts: the rows whose counts cover a rank are the values at it."""
    found, total = running_counts(df, group, features, parts)
    placed = _met(found, total, [*group, "feature"])
    holds = lambda rank: (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
    position = {name: F.lit(q) * (F.col("total") - 1) for name, q in at.items()}
    picked = [F.max(F.when(holds(f(p)), F.col("value"))).alias(f"{side}_{name}") for name, p in position.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    order = placed.groupBy(*group, "feature", "total").agg(*picked)

    def between(name: str) -> Column:
        lo, hi, p = F.col(f"lo_{name}"), F.col(f"hi_{name}"), position[name]
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    each = order.select(*group, "feature", "total", *[between(name).alias(name) for name in at])
    of = lambda i, c: F.max(F.when(F.col("feature") == i, F.col(c)))
    wide = each.groupBy(*group).agg(*[x for i, f in enumerate(features) for x in (of(i, "total").alias(f"{f}_count"), *[of(i, name).alias(f"{f}_{name}") for name in at])])
    groups = df.select(*group).distinct()  # a group without any value has counts of zero
    return _met(groups, wide, group, "left").na.fill(0, [f"{f}_count" for f in features])


def _held(df: DataFrame, group: list[str], features: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles from all values of a group in one buffer."""
    aggs = []
    for f in features:
        q = F.percentile(f, F.array(*[F.lit(x) for x in at.values()]))
        aggs += [F.count(f).alias(f"{f}_count"), *[F.get(q, F.lit(i)).alias(f"{f}_{name}") for i, name in enumerate(at)]]
    return df.groupBy(*group).agg(*aggs)


def quantiles(df: DataFrame, group: list[str], features: list[str], at: dict[str, float], hot: int = BUFFERED, parts: int | None = None) -> DataFrame:
    """(*group, <feature>_count, <feature>_<name> for each quantile of `at`): exact, interpolated between neighbouring ranks."""
    df = settled(df, "peer-rows")
    large = _hot(df, group, hot)
    if large is None:
        return _held(df, group, features, at)
    few = F.broadcast(large)
    rest, many = _held(_met(df, few, group, "left_anti"), group, features, at), _order_statistics(cut(_met(df, few, group, "left_semi"), "peer-hot"), group, features, at, parts)
    return rest.unionByName(many.select(rest.columns))
