"""The k most alike candidates of each name by words and length, without pairing all names that hold a common word.

The rough score of a pair is a weighted sum of the Jaccard similarity of word sets and the ratio of lengths. Three joins make a superset
of every name's k best:

* Rare words, of at most COMMON candidates, are joined directly: a name meets COMMON candidates for each of them at most.
* For candidates that share common words only, the score depends on which common words they hold, how many words and how many
  characters: candidates that agree on these are one cell, of which the first k in tie order are enough. Cells of names meet cells of
  candidates, whatever the number of either, and a name goes on only to the cells that fewer than k candidates of better cells precede.
* Of candidates that share nothing, only the length counts: cells are lengths, taken from the nearest outwards.

A candidate that also shares a rare word scores higher than its cell says, and was met by that word; so no cell leaves out a candidate that
k others don't precede.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.store import BROADCAST_BYTES, cut, hinted

#: Weights of word overlap and of length.
OVERLAP, LENGTH = 0.8, 0.2
#: Candidates that may hold a word before it counts as common.
COMMON = 256


def words(key: Column) -> Column:
    return F.array_distinct(F.split(key, " "))


def rough(shared: Column, n_a: Column, n_b: Column, len_a: Column, len_b: Column) -> Column:
    """The score of word sets of n_a and n_b words, of which `shared` are common, and keys of these lengths."""
    return OVERLAP * (shared / (n_a + n_b - shared)) + LENGTH * (F.least(len_a, len_b) / F.greatest(len_a, len_b, F.lit(1)))


def _cells(df: DataFrame, id_col: str, hot: DataFrame) -> DataFrame:
    """(id, sig, n, len): the common words of each key, and how many words and characters it has; only keys with such words."""
    each = df.select(id_col, F.size(words(F.col("key"))).alias("n"), F.length("key").alias("len"), F.explode(words(F.col("key"))).alias("word"))
    return each.join(hot, "word").groupBy(id_col, "n", "len").agg(F.array_sort(F.collect_set("word")).alias("sig"))


def _first(df: DataFrame, cell: list[str], tie: list[str], most: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*cell).orderBy(*tie))).filter(F.col("__r") <= most).drop("__r")


def _small(df: DataFrame, cell: list[str], cells: tuple[str, ...]) -> DataFrame:
    """`df` to be broadcast if its rows with all words of their cells are few bytes."""
    words_in = sum((F.size(f"{c}.sig") for c in cells), F.lit(0))
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(words_in), F.lit(0))).first()
    return F.broadcast(df) if n * (24 + 8 * (len(df.columns) + len(cell) * len(cells))) + held * 32 <= BROADCAST_BYTES else df


def _dealt(names: DataFrame) -> DataFrame:
    """Names over all partitions, which a small table, or one that was grouped by cell, is not: each name makes as many pairs as are wanted."""
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")


def _by_common_words(names: DataFrame, cand: DataFrame, hot: DataFrame, tie: list[str], most: int) -> DataFrame:
    """(name, cid) by cells of common words."""
    cell = ["sig", "n", "len"]
    members = cut(_first(_cells(cand, "cid", hot).join(cand.select("cid", *tie), "cid"), cell, tie, most).select("cid", *cell), "shortlist-members")
    own = cut(_cells(names, "name", hot), "shortlist-names")
    sizes = members.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
    a = own.select(*cell).distinct().select(F.struct(*cell).alias("a"), F.explode("sig").alias("word"))
    b = sizes.select(F.struct(*cell).alias("b"), "size", F.explode("sig").alias("word"))
    met = a.join(b, "word").select("a", "b", "size").distinct()
    score = rough(F.size(F.array_intersect("a.sig", "b.sig")), F.col("a.n"), F.col("b.n"), F.col("a.len"), F.col("b.len"))
    down = W.partitionBy("a").orderBy(F.desc("score"))
    better = F.sum("size").over(down.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("size").over(down.rangeBetween(0, 0))
    kept = cut(met.withColumn("score", score).withColumn("better", better).filter(F.col("better") < most).select("a", "b"), "shortlist-cells")
    # Names of one cell, who may be all of them, are no key to shuffle by: cells and their first members go to the names while they are small.
    cells, first = (_small(x, cell, cells_of) for x, cells_of in ((kept, ("a", "b")), (members.select("cid", F.struct(*cell).alias("b")), ("b",))))
    there = _dealt(own).select("name", F.struct(*cell).alias("a")).join(cells, "a")
    return there.join(first, "b").select("name", "cid")


def _by_length(names: DataFrame, cand: DataFrame, tie: list[str], most: int) -> DataFrame:
    """(name, cid) by length alone. What the driver sees are lengths that occur, as many as the longest name has characters at most."""
    members = cut(_first(cand.withColumn("len", F.length("key")), ["len"], tie, most).select("cid", "len"), "shortlist-lengths")
    sizes = {r["len"]: r["count"] for r in members.groupBy("len").count().collect()}
    taken = []
    for own in sorted(r[0] for r in names.select(F.length("key")).distinct().collect()):
        ratio = lambda n: min(own, n) / max(own, n, 1)  # noqa: E731, B023
        better, tied, last = 0, 0, None
        for n in sorted(sizes, key=lambda n: (-ratio(n), n)):
            if ratio(n) != last:
                better, tied, last = better + tied, 0, ratio(n)
            if better >= most:
                break
            taken.append((own, n))
            tied += sizes[n]
    wanted = names.sparkSession.createDataFrame(taken, "own int, len int")
    return _dealt(names).select("name", F.length("key").alias("own")).join(F.broadcast(wanted), "own").join(hinted(members), "len").select("name", "cid")


def candidates_for(names: DataFrame, cand: DataFrame, tie: list[str], most: int, common: int = COMMON) -> DataFrame:
    """(name, cid): pairs among which are the `most` best of each name, ties by the columns `tie`.

    `names` (name, key), `cand` (cid, key, *tie), both cut tables, once for each name and cid.
    """
    held = cand.select(F.explode(words(F.col("key"))).alias("word")).groupBy("word").count()
    hot = cut(held.filter(F.col("count") > common).select("word"), "shortlist-common")
    rare = lambda df, i: df.select(i, F.explode(words(F.col("key"))).alias("word")).join(hot, "word", "left_anti")
    met = rare(names, "name").join(rare(cand, "cid"), "word").select("name", "cid")
    return met.unionByName(_by_common_words(names, cand, hot, tie, most)).unionByName(_by_length(names, cand, tie, most)).distinct()
