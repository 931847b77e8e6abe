"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. Built-in functions only.

Items and documents are sets of distinct five-word shingle hashes; an item of fewer words is one shingle of its own
length, which is then looked for in documents too. Items are partitioned by set size (powers of two), and the bound of
each partition gives the length of its MinHash signatures: an item that a document contains to `percent` lacks at most
(100 - percent) % of its shingles there, so of a signature longer by MARGIN than that at least MARGIN minima are found
in the document (all that is allowed to be there, for the smallest items). Candidate search therefore loses nothing, and
one phrase that many documents share makes no candidate by itself. A document is sketched by the same rule: of its hashes
only those up to the largest minimum of any signature can meet one. A document with fewer shingles than an item needs is
never its candidate. Candidates are then verified by exact shingle containment over their whole texts.

Edge cases: null texts and texts without words have no shingles and match nothing, as items or as documents; an item of a
few words matches every document that holds them in sequence; rows that share an id are one item or document; rows
without an id give no pair, as there is nothing to report, but `drop_contaminated` judges every row; empty tables give
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.store import cut, hinted, table
from veldspar.llm.text import let, row_key, shingles, words

#: Minima by which a signature is longer than what may be missing.
MARGIN = 2


def signatures(items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n, s (all shingle hashes, ascending), least (shingles that a document must hold), m (length of the
    signature, a prefix of s), need (minima of it that such a document holds at least)."""
    own = F.coalesce(*[F.when(F.size("w") == n, shingles(F.col(text_col), n)) for n in range(1, k)], shingles(F.col(text_col), k)) if k > 1 else shingles(F.col(text_col), k)
    one = items.select(F.col(id_col).alias("item_id"), text_col, words(F.col(text_col)).alias("w")).filter("item_id IS NOT NULL").select("item_id", F.explode(own).alias("h"))
    sets = one.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("s")).withColumn("n", F.size("s"))
    sized = cut(sets.withColumn("part", F.floor(F.log2("n")).cast("int")), "decon-items")
    top = sized.groupBy("part").agg(F.max("n").alias("u"))  # one row for each power of two
    m = F.least(F.col("n"), F.expr(f"cast(u * {100 - percent} div 100 + {MARGIN} AS int)"))
    signed = sized.join(F.broadcast(top), "part").withColumns({"m": m, "least": F.expr(f"cast((n * {percent} + 99) div 100 AS int)")})
    return signed.select("item_id", "n", "s", "least", "m", F.expr("m - (n - least)").alias("need"))


def _short(items: DataFrame, k: int, text_col: str = "text") -> list[int]:
    """The lengths below k that items have: at most k - 1 numbers."""
    n = F.size(words(F.col(text_col)))
    return sorted(r["n"] for r in items.select(n.alias("n")).filter(F.col("n").between(1, k - 1)).distinct().collect())


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared) in which the document holds at least `percent` % of the item's shingles."""
    signed = cut(signatures(items, k, percent), "decon-signatures")
    lengths = (*_short(items, k), k)
    slots = signed.select("item_id", "least", "need", F.explode(F.slice("s", 1, F.col("m"))).alias("h"))
    bound = signed.agg(F.max(F.element_at("s", F.col("m"))).alias("top")).first()
    top = bound["top"] or 0
    # One expression, exploded with its empty rows: a filter on the shingles, stated or inferred, would make them twice.
    low = let(shingles(F.col(text_col), *lengths), lambda s: F.transform(F.filter(s, lambda h: h <= F.lit(top)), lambda h: F.struct(h.alias("h"), F.size(s).alias("size"))))
    probes = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode_outer(low).alias("p")).select("doc_id", "p.h", "p.size")
    hits = probes.join(hinted(slots), "h").filter("size >= least")
    candidates = cut(hits.groupBy("doc_id", "item_id", "need").agg(F.count_distinct("h").alias("found")).filter("found >= need").select("doc_id", "item_id"), "decon-candidates")

    involved = cut(candidates.select("doc_id").distinct(), "decon-docs")
    whole = docs.join(hinted(involved.withColumnRenamed("doc_id", "__c"), of=involved), F.col(id_col) == F.col("__c"), "left_semi")
    again = whole.select(F.col(id_col).alias("doc_id"), F.explode_outer(shingles(F.col(text_col), *lengths)).alias("h"))
    all_slots = signed.select("item_id", "n", F.explode("s").alias("h"))
    shared = again.join(hinted(all_slots), "h").join(hinted(candidates, of=candidates), ["doc_id", "item_id"], "left_semi")
    counted = shared.groupBy("doc_id", "item_id", "n").agg(F.count_distinct("h").alias("n_shared"))
    return counted.filter(F.col("n_shared") * 100 >= F.col("n") * percent).select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), "n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that contain an item; all columns stay. Each row is judged by its own text, whatever its id."""
    key = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(key.alias("__key"), F.col(text_col))
    leaks = cut(contaminated(rows, items, id_col="__key", text_col=text_col).select(F.col("doc_id").alias("__leak")).distinct(), "decon-leaks")
    return docs.join(hinted(leaks, of=leaks), key == F.col("__leak"), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
      FROM {source} WHERE {key} IS NOT NULL"""


#: Items of under five words are one shingle; documents give shingles of every length that items need.
SQL = f"""
WITH iw AS ({_words_sql("benchmark", "item_id")}), dw AS ({_words_sql("documents", "doc_id")}),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, list_aggregate(w[j:j + least(len(w), 5) - 1], 'string_agg', ' ') AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS j FROM iw WHERE len(w) > 0)),
d AS (SELECT DISTINCT doc_id, list_aggregate(w[j:j + k - 1], 'string_agg', ' ') AS h FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM dw, k WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM d JOIN i USING (h) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""
