"""Running sums and fill-down over ordered rows, where one key may hold any share of them.

A window over a key sorts all its rows in one task. Here rows are dealt by ranges of (key, order) instead, so that a hot key
lies in many ranges; each range is scanned by itself, and what the ranges before it leave to a key is carried in. Only keys
that lie in more than one range need a carry. Such a key is the last of one range and the first of the next, so there are
fewer of them than ranges, and the carry table is broadcast with that bound: ranges times columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.store import cut

RANGE, _KEY = "__range", "__key"


def _key(keys: list[str]) -> Column:
    """All keys as one struct, which equals another where both have nulls."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def ranged(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "ranged", parts: int | None = None) -> DataFrame:
    """The rows of `df` as a cut table, dealt by ranges of (keys, order) and with the number of the range. Rows that agree on both share one."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    return cut(df.repartitionByRange(parts, *by).withColumn(RANGE, F.spark_partition_id()), name)


def _spanning(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that lie in more than one range; fewer than there are ranges."""
    if not keys:
        return rows.sparkSession.range(1).select(_key([]).alias(_KEY))
    edges = rows.groupBy(RANGE).agg(F.min(_key(keys)).alias("lo"), F.max(_key(keys)).alias("hi"))
    return edges.select(RANGE, F.explode(F.array_distinct(F.array("lo", "hi"))).alias(_KEY)).groupBy(_KEY).count().filter("count > 1").select(_KEY)


def scan(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, name: str = "ranged", parts: int | None = None, dealt: bool = False) -> DataFrame:
    """`df` with inclusive running `sums`, and with `lasts`: the last value so far that is not null.

    `dealt`: the ranges are kept as a column of the result, and a scan of a table that has them deals nothing out again.
    `order` has to tell the rows of a key apart, except where ties may fall either way; for `lasts` it is plain column names,
    ascending. Null keys are a key like others. Floating-point sums may differ in the last digit from a scan in one task.
    """
    sums, lasts = sums or {}, lasts or {}
    rows = df if RANGE in df.columns else ranged(df, keys, order, name, parts)
    own = _key(keys)
    folds = [F.sum(c).alias(n) for n, c in sums.items()]
    folds += [F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(n) for n, c in lasts.items()]
    left = rows.withColumn(_KEY, own).join(F.broadcast(_spanning(rows, keys)), _KEY, "left_semi").groupBy(_KEY, RANGE).agg(*folds)
    before = W.partitionBy(_KEY).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carried = [F.sum(n).over(before).alias(f"__c_{n}") for n in sums] + [F.last(n, True).over(before).alias(f"__c_{n}") for n in lasts]
    carry = left.select(F.col(_KEY).alias("__carry_key"), F.col(RANGE).alias("__carry_range"), *carried)
    so_far = W.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = {n: F.sum(c).over(so_far) for n, c in sums.items()} | {n: F.last(c, True).over(so_far) for n, c in lasts.items()}
    met = rows.withColumns(local).withColumn(_KEY, own).join(F.broadcast(carry), (F.col(_KEY) == F.col("__carry_key")) & (F.col(RANGE) == F.col("__carry_range")), "left")
    whole = {n: F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in lasts}
    kept = [c for c in rows.columns if c not in whole and (dealt or c != RANGE)]
    return met.withColumns(whole).select(*[F.col(f"`{c}`") for c in kept], *whole)
