"""Columns that a sheet lost and gained, paired as possible renames.

A pair's confidence is a weighted sum of the likeness of names, equal position and equal type. Nothing compares all pairs:

* Names alone can't reach the least confidence, so a pair agrees on its position, its type, or both. Pairs of one position meet by
  an equi join, one to one. Pairs of one type only need names that are nearly the same, and meet on a shared bigram: of two names of
  T characters together, M of which match in order, at least M - (T - 2M + 1) bigrams (with their number of occurrence) are shared,
  so that each name posts only its rarest bigrams, as many as it can lack and one more. Both joins lose no pair.
* One-to-one pairs are made in rounds: a pair that is the best left for its lost and for its gained column is taken, and all other pairs
  of these columns go. That is what taking pairs from the best downwards gives, without an order over all of them.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.store import cut

#: Weights of names, position and type, and the least confidence of a pair.
TEXT, POSITION, TYPE, LEAST = 0.7, 0.2, 0.1, 0.72

#: The likeness that names need where type alone, or anything, agrees; a little less, as sums of floats are rounded.
ALIKE, ANY = (LEAST - TYPE) / TEXT - 1e-9, (LEAST - POSITION - TYPE) / TEXT - 1e-9
#: Share of the characters of two names of that likeness that bigrams in common are bound to: M - (T - 2M + 1) = SHARED * T - 1.
SHARED = 1.5 * ALIKE - 1.0


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks; differs with the order of its arguments."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _bigrams(name: Column) -> Column:
    """All pairs of neighbouring characters, each with its number of occurrence, so that an array of them is a set."""
    n = F.char_length(name)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(name, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, 1, i), lambda q: q == p)).cast("string")))


def _posted(side: DataFrame, keys: list[str], common: DataFrame) -> DataFrame:
    """(*keys, name, n, bigram): the rarest bigrams of each name, as many as a like name of another sheet can lack, and one more."""
    n = F.char_length("name")
    ranked = side.select(*keys, "name", F.explode(_bigrams(F.col("name"))).alias("bigram")).join(common, [*keys, "bigram"])
    by_name = ranked.groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.struct("held", "bigram"))).alias("b"))
    # The shortest name that is like one of n characters has n * ALIKE / (2 - ALIKE).
    needed = F.greatest(F.lit(1), F.ceil(SHARED * n * (1 + ALIKE / (2 - ALIKE)) - 1 - 1e-9))
    kept = F.slice("b", F.lit(1), F.greatest(F.size("b") - needed + 1, F.lit(0)).cast("int"))
    return by_name.select(*keys, "name", n.alias("n"), F.explode(kept).alias("x")).select(*keys, "name", "n", "x.bigram")


def _of_one_type(lost: DataFrame, gained: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, old, new): pairs of one type whose names may be alike enough; a superset."""
    keys = [*keys, "kind"]
    typed = [side.select(*keys, "name") for side in (lost, gained)]
    common = typed[0].unionByName(typed[1]).select(*keys, F.explode(_bigrams(F.col("name"))).alias("bigram")).groupBy(*keys, "bigram").agg(F.count(F.lit(1)).alias("held"))
    a, b = (_posted(side, keys, common) for side in typed)
    met = a.withColumnsRenamed({"name": "old", "n": "n_old"}).join(b.withColumnsRenamed({"name": "new", "n": "n_new"}), [*keys, "bigram"])
    return met.filter(2 * F.least("n_old", "n_new") >= ALIKE * (F.col("n_old") + F.col("n_new"))).select(*keys[:-1], "old", "new").distinct()


def candidates(lost: DataFrame, gained: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, old, new, confidence) of all pairs with the least confidence.

    Sides are (*keys, name, position, kind), one row for each name of a key. A null position or kind agrees with none.
    """
    old = lost.withColumnsRenamed({"name": "old", "position": "p_old", "kind": "k_old"})
    new = gained.withColumnsRenamed({"name": "new", "position": "p_new", "kind": "k_new"})
    placed = old.withColumn("position", F.col("p_old")).join(new.withColumn("position", F.col("p_new")), [*keys, "position"]).select(*keys, "old", "new")
    pairs = placed.unionByName(_of_one_type(lost, gained, keys)).distinct()
    full = pairs.join(old, [*keys, "old"]).join(new, [*keys, "new"])
    n = F.char_length("old") + F.char_length("new")
    same_place, same_kind = (F.coalesce(F.col(f"{c}_old") == F.col(f"{c}_new"), F.lit(False)) for c in "pk")
    may = full.filter(2 * F.least(F.char_length("old"), F.char_length("new")) >= ANY * n)
    scored = may.withColumn("likeness", likeness("old", "new"))
    confidence = F.lit(TEXT) * F.col("likeness") + F.lit(POSITION) * same_place.cast("int") + F.lit(TYPE) * same_kind.cast("int")
    return scored.select(*keys, "old", "new", confidence.alias("confidence")).filter(F.col("confidence") >= LEAST)


def one_to_one(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of (*keys, old, new, confidence), the pairs that are taken from the best downwards, each column once; ties by name, last first."""
    left, taken = cut(pairs, "rename-pairs"), None
    score = F.struct("confidence", "old", "new")
    while left.head(1):
        best = [left.groupBy(*keys, side).agg(F.max(score).alias(f"best_{side}")) for side in ("old", "new")]
        mutual = left.join(best[0], [*keys, "old"]).join(best[1], [*keys, "new"]).filter((F.col("best_old") == F.col("best_new")) & (F.col("best_old") == score))
        mutual = cut(mutual.select(*keys, "old", "new", "confidence"), "rename-taken")
        taken = mutual if taken is None else taken.unionByName(mutual)
        rest = left.join(mutual.select(*keys, "old"), [*keys, "old"], "left_anti").join(mutual.select(*keys, "new"), [*keys, "new"], "left_anti")
        left = cut(rest.select(*keys, "old", "new", "confidence"), "rename-left")
    return left if taken is None else taken


def paired(lost: DataFrame, gained: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, old, new, confidence): possible renames among the columns (*keys, name, position, kind) that each key lost and gained."""
    return one_to_one(candidates(lost, gained, keys), keys)
