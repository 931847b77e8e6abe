"""Resampling documents towards a target distribution, by importance weights over hashed n-grams and Gumbel noise.

Features of a text are its runs of one to `longest` consecutive words, hashed by CRC-32 into `buckets`. A bucket's gain is the
scaled log-ratio of its frequency in the target to that in the corpus (both counted over all texts, one added everywhere); a
document's weight is the sum of its features' gains, looked up in one array of `buckets` numbers. With Gumbel noise from a hash of
the id added, the highest scores are a sample without replacement in proportion to the exponentiated weights.

Scores are integers, so ranks come from an exact histogram: the cutoff is found by counting scores in BINS intervals, then within
the interval that holds it, until it is one score wide; suffix sums over the distinct surviving scores (a scan over ranges, no
single task) give the rank at which each score begins, and row_number by id places the documents within a score. Texts are read
twice and never shuffled; everything after that works on a few numbers for each document.

CRC-32 is computed for all words of a block of texts at once: the checksum is linear over bits, so that the checksum of a run of words
follows from the words' own by one table look-up for each byte of the register, given the length of the part that is appended.

Edge cases: null text has no features and the weight 0; texts with fewer than `least_words` words are scored but not drawn; a null id
is scored with the noise of an empty id and is last among ties; rows that repeat an id are rows of their own, in any order among
themselves where all else is equal; an empty target gives every bucket the same treatment (its counts are 0); an empty table gives an
empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.llm import numtext
from veldspar.llm.store import cut, passing, short_batches, table
from veldspar.plans.scan import scan

BUCKETS, LONGEST, SCALE = 10_000, 3, 1000
#: Share drawn of the documents with at least LEAST_WORDS words, and the salt of their noise.
PERCENT, LEAST_WORDS, SALT = 5, 20, "42:"
#: Intervals that scores are counted in at a time; these counts are all that the driver sees of the corpus.
BINS = 4096
_ONES = np.uint32(0xFFFFFFFF)
#: Words of more bytes are hashed one by one.
_SHORT = 48

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_tables: list[np.ndarray] = []


def _crc_tables() -> list[np.ndarray]:
    """[byte step (256), zeros[level][n][byte place][byte]: the register after n * 256^level zero bytes, bit-linear in each byte]."""
    if not _tables:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        zeros = np.zeros((4, 256, 4, 256), np.uint32)
        for place in range(4):
            zeros[0, 0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        for level in range(4):
            if level:
                # One unit of this level is 255 units of the level below and one more.
                zeros[level, 0] = zeros[0, 0]
                unit = _appended(zeros[level - 1, 255], zeros[level - 1, 1])
            else:
                unit = step[zeros[0, 0] & 255] ^ (zeros[0, 0] >> 8)
            for n in range(1, 256):
                zeros[level, n] = unit if n == 1 else _appended(zeros[level, n - 1], unit)
        _tables[:] = [step, zeros]
    return _tables


def _appended(register: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The registers after as many zero bytes as `table` (byte place, byte) stands for."""
    return table[0][register & 255] ^ table[1][(register >> 8) & 255] ^ table[2][(register >> 16) & 255] ^ table[3][register >> 24]


def zeros_after(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRC registers after n zero bytes, for arrays of registers and of lengths below 2^32."""
    zeros = _crc_tables()[1]
    low = n & 255
    out = zeros[0, low, 0, register & 255] ^ zeros[0, low, 1, (register >> 8) & 255] ^ zeros[0, low, 2, (register >> 16) & 255] ^ zeros[0, low, 3, register >> 24]
    for level in (1, 2, 3):
        at = np.flatnonzero(n >> (8 * level))
        if not len(at):
            break
        d, r = (n[at] >> (8 * level)) & 255, out[at]
        out[at] = zeros[level, d, 0, r & 255] ^ zeros[level, d, 1, (r >> 8) & 255] ^ zeros[level, d, 2, (r >> 16) & 255] ^ zeros[level, d, 3, r >> 24]
    return out


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block of texts, and where each text's words begin (one more than texts)."""
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (edge[:-1] | ~before))
    ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC register of each A-Z-lower-cased word, started at zero."""
    step = _crc_tables()[0]
    low, length = _LOWER[data], ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    long = int((length > _SHORT).sum())
    for i in order[:long]:
        out[i] = np.uint32(zlib.crc32(low[starts[i] : ends[i]].tobytes())) ^ _ONES
    if long:
        out[order[:long]] ^= zeros_after(np.full(long, _ONES), length[order[:long]])
    rest = order[long:]
    sizes, at, register = length[rest], starts[rest], np.zeros(len(rest), np.uint32)
    for j in range(int(sizes[0]) if len(rest) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))  # words longer than j bytes come first
        register[:n] = step[(register[:n] ^ low[at[:n] + j]) & 255] ^ (register[:n] >> 8)
    out[rest] = register
    return out


def feature_buckets(column: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST):
    """For each block of texts: (numbers of words, for each run length (buckets of all runs, where each text's begin))."""
    step = _crc_tables()[0]
    for _, data, off in numtext.blocks(column):
        starts, ends, at = words_of(data, off)
        length, n = ends - starts, np.diff(at)
        alone = word_registers(data, starts, ends)
        spaced = zeros_after(np.full(len(alone), step[32]), length) ^ alone  # of a blank and the word
        state, runs = zeros_after(np.full(len(alone), _ONES), length) ^ alone, []
        for size in range(1, longest + 1):
            if size > 1:
                state = zeros_after(state[:-1], length[size - 1 :] + 1) ^ spaced[size - 1 :]
            # Runs that begin in the last words of a text would reach into the next.
            inside = np.zeros(len(starts) + 1, np.int64)
            ok = np.ones(len(state), bool)
            for back in range(1, size):
                last = at[1:] - back
                last = last[(last >= at[:-1]) & (last < len(ok))]
                ok[last] = False
            inside[1 : len(ok) + 1] = ok
            inside = np.cumsum(inside)
            runs.append((((state ^ _ONES) % np.uint32(buckets))[ok], inside[at]))
        yield n, runs


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket occurs in all texts (one column of them). A task sums its own, so `buckets` rows leave it at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, runs in feature_buckets(b.column(0), buckets, longest):
                for found, _ in runs:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    got = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * log of the frequency in the target to that in the corpus) of each bucket."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(scale * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    so_far = np.concatenate(([0], np.cumsum(values)))
    return so_far[at[1:]] - so_far[at[:-1]]


def weigher(gain, longest: int = LONGEST):
    """Function of a text column: a struct of n_words, n_features and weight. `gain`: the broadcast array."""

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(text: pa.Array) -> pa.Array:
        n_words, n_features, weight = [], [], []
        for n, runs in feature_buckets(text, len(gain.value), longest):
            n_words.append(n)
            n_features.append(sum(np.diff(at) for _, at in runs))
            weight.append(sum(_summed(gain.value[found], at) for found, at in runs))
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in (n_words, n_features, weight)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n_words", "n_features", "weight"])

    return weigh


def noise(row_id: Column, salt: str = SALT, scale: int = SCALE) -> Column:
    """Gumbel noise of an id, times `scale`, as an integer."""
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(row_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((hashed + 0.5) / F.lit(4294967296.0))))


def cutoff(scores: DataFrame, wanted: int) -> int | None:
    """The `wanted`-th highest of the integer scores (one column, score); None where there are fewer.

    Each round counts the scores of one interval in BINS parts of it and goes on with the part that holds the rank, so that six
    rounds are enough for any 64-bit integers.
    """
    lo, hi, n = scores.agg(F.min("score"), F.max("score"), F.count("score")).first()
    if wanted < 1 or n < wanted:
        return None
    while lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        part = F.floor((F.col("score") - F.lit(lo)) / F.lit(width)) if hi - lo < 1 << 52 else F.expr(f"cast((cast(score AS decimal(20,0)) - {lo}BD) div {width}BD AS long)")
        counted = sorted(scores.filter(F.col("score").between(lo, hi)).groupBy(part.cast("long").alias("b")).count().collect(), reverse=True)
        for b, count in counted:
            if wanted <= count:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            wanted -= count
    return lo


def ranked(scored: DataFrame, wanted: int, able: str = "true", id_col: str = "doc_id") -> DataFrame:
    """`scored`, a cut table, with `rank`: from 1 for the `wanted` highest scores of the rows that are `able`, ties by id; else null."""
    drawn = F.coalesce(F.expr(able), F.lit(False))
    least = cutoff(scored.filter(drawn).select("score"), wanted)
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select("*", none)
    drawn = drawn & (F.col("score") >= least)
    # Down to a score there are `upto` rows, the score's own included; the suffix sums are over distinct scores.
    histogram = scored.filter(drawn).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    begins = scan(histogram, [], [F.desc("score")], sums={"upto": F.col("n")}, name="resample-suffix").select("score", (F.col("upto") - F.col("n")).alias("before"))
    own = W.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), *[c for c in scored.columns if c not in ("score", id_col)])
    rank = F.col("before") + F.row_number().over(own)
    placed = scored.filter(drawn).join(begins, "score").withColumn("rank", rank)
    placed = placed.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return placed.unionByName(scored.filter(~drawn).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", salt: str = SALT) -> DataFrame:
    """Every row of `docs`: its id (doc_id), n_features, weight, score, rank (null where it isn't drawn), n_words."""
    spark = docs.sparkSession
    with passing(), short_batches(spark):
        gain = gains(bucket_counts(docs.select(text_col), buckets, longest), bucket_counts(target.select(target_col), buckets, longest))
        weight = weigher(spark.sparkContext.broadcast(gain), longest)(F.col(text_col))
        weighed = docs.select(F.col(id_col).alias("doc_id"), weight.alias("w")).select("doc_id", "w.*")
        scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt)), "resample-scored")
        able = f"n_words >= {least_words}"
        return cut(ranked(scored, scored.filter(able).count() * percent // 100, able), "resample", keep=True).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight and score towards the benchmark texts, and the rank of those drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), r AS (
  SELECT row, NULL AS target, unnest(w) AS f FROM d
  UNION ALL SELECT row, NULL, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
  UNION ALL SELECT row, NULL, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d
  UNION ALL SELECT NULL, 1, unnest(w) FROM b
  UNION ALL SELECT NULL, 1, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b
  UNION ALL SELECT NULL, 1, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM b
), n AS (SELECT f, row, target, count(*) AS n FROM r GROUP BY ALL),
u AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM n),
c AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 10000 AS bucket
  FROM u
), m AS (SELECT n.row, n.target, c.bucket, n.n FROM n JOIN c USING (f)),
s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE target IS NULL), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE target = 1), 0)::DOUBLE AS t FROM m GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000)))) AS BIGINT) AS gain FROM s),
w AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM m JOIN g USING (bucket) WHERE row IS NOT NULL GROUP BY row),
x AS (
  SELECT d.row, doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (row)
), k AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 5 // 100 THEN rank END AS rank, n_words FROM x LEFT JOIN k USING (row)
"""
