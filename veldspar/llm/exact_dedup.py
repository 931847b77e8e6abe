"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Edge cases: null text counts as empty; texts are equal when identical after lower-casing A-Z only. A null id sorts
below every other id. Rows that repeat both id and text are one document: they count in group_size and give one row.
An empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.store import cut, hinted, passing
from veldspar.llm.text import lower_az

SCHEMA = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_rows", "n_bytes")
#: Bits of the table that marks surviving keys: 8 for each key, but no more than 2^LARGEST (32 MB, which is broadcast).
SMALLEST, LARGEST = 20, 28
#: Copies of a text from which its group meets its members by broadcast; such groups are few, one in HOT rows at most.
HOT = 100_000


def _marked(keys: DataFrame, bits: int) -> DataFrame:
    """A bitmap over the hashes of `keys` (len, head) as rows of 32,768 bits: bucket, bitmap."""
    at = F.pmod(F.xxhash64("len", "head"), F.lit(1 << bits))
    return keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def _split(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """`rows` with `alive`: whether the key's bit is set. Keys that survive always are; the full hash tells others apart."""
    at = F.pmod(F.xxhash64("len", "head"), F.lit(1 << bits))
    placed = rows.withColumns({"__b": F.bitmap_bucket_number(at), "__p": F.bitmap_bit_position(at).cast("int")})
    byte = F.conv(F.hex(F.substr("bitmap", F.expr("__p div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    alive = F.expr("shiftright(__byte, __p % 8) & 1") == 1
    return placed.join(F.broadcast(bitmap), F.col("__b") == F.col("bucket"), "left").withColumn("__byte", F.coalesce(byte, F.lit(0))).withColumn("alive", alive).drop("__b", "__p", "__byte", "bucket", "bitmap")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, hash_single: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id (largest id of its group), group_size, kept, text_sha256,
    n_rows (rows that repeat this id and text), n_bytes (of the text).

    Pass 1 reads lengths and the first `prefix` characters. Pass 2 hashes whole texts of the surviving (length, prefix
    hash) groups; the others are settled without. Which keys survive is told by a bitmap of bounded size: where keys
    are so many that it fills up, some more texts are hashed, and the rows are the same. Texts are never shuffled. The
    digest is given for groups of two or more, and for all documents if `hash_single` asks for it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    keyed = rows.select("doc_id", "t", F.octet_length("t").alias("len"), F.xxhash64(lower_az(F.substring("t", 1, prefix))).alias("head"))
    digest = F.sha2(lower_az(F.col("t")), 256).alias("text_sha256")
    with passing():
        sketch = cut(keyed.select("doc_id", "len", "head"), "dedup-sketch", keep=True)
        lengths = cut(sketch.groupBy("len").count().filter("count > 1").select("len"), "dedup-lengths")
        heads = cut(sketch.join(hinted(lengths, of=lengths), "len", "left_semi").groupBy("len", "head").count().filter("count > 1").select("len", "head"), "dedup-heads")
        bits = min(max(SMALLEST, (8 * heads.count()).bit_length()), LARGEST)
        bitmap = cut(_marked(heads, bits), "dedup-bitmap", keep=True)
        # A hot group is spread over (digest, id) first; its members meet only as one partial row per task.
        survivors = _split(keyed, bitmap, bits).filter("alive").select("doc_id", "len", digest)
        members = cut(survivors.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"), F.min("len").alias("n_bytes")), "dedup-members", keep=True)
        groups = cut(members.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "dedup-groups", keep=True)

    rest = _split(keyed if hash_single else sketch, bitmap, bits).filter("NOT alive")
    none = F.lit(None).cast("string").alias("text_sha256")
    one = F.lit(1).cast("long")
    settled = rest.select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), digest if hash_single else none, one.alias("n_rows"), F.col("len").alias("n_bytes"))
    hot = hinted(groups.filter(F.col("group_size") >= HOT).select("text_sha256"))
    met = [members.join(hot, "text_sha256", "left_anti").join(groups, "text_sha256"), members.join(hinted(groups.filter(F.col("group_size") >= HOT)), "text_sha256")]
    shown = F.col("text_sha256") if hash_single else F.when(F.col("group_size") > 1, F.col("text_sha256"))
    hashed = met[0].unionByName(met[1]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), shown.alias("text_sha256"), F.col("n").alias("n_rows"), "n_bytes")
    return settled.unionByName(hashed).select(*SCHEMA)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the copies: of equal texts the row with the largest id stays, with all its columns. Of rows that
    repeat both id and text one stays; rows that share an id but not the text are told apart.

    Rows meet what was found by id and length; a text is hashed only where these agree.
    """
    found = cut(exact_dedup(docs, id_col, text_col).filter("NOT kept OR n_rows > 1").select(F.col("doc_id").alias("__id"), F.col("n_bytes").alias("__n"), F.col("text_sha256").alias("__sha"), F.col("kept").alias("__kept")), "dedup-found")
    sha, n = F.sha2(lower_az(F.coalesce(F.col(text_col), F.lit(""))), 256), F.coalesce(F.octet_length(text_col), F.lit(0))
    # The last condition is an equality that can't become a key of the join, which would be computed for every row.
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (n == F.col("__n")) & (F.greatest(sha, F.col("__sha")) == F.least(sha, F.col("__sha")))
    single = docs.join(hinted(found), same, "left_anti")
    repeated = found.filter("__kept")
    if not repeated.head(1):
        return single
    return single.unionByName(docs.join(hinted(repeated), same, "inner").dropDuplicates(["__id", "__sha"]).drop("__id", "__n", "__sha", "__kept"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the id that stays, its group's size and its digest."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), hash_single=True).drop("n_bytes")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256, count(*) AS n_rows
FROM d JOIN g USING (text_sha256) GROUP BY ALL
"""
