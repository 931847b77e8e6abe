"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; each model sees, besides features of the text, the log-odds that the earlier
models of the chain gave. In training those come from out-of-fold models, so that a later model learns to trust an
earlier one only as far as it is right on texts it hasn't seen. Features are byte 5-grams of the text (A-Z lower-cased,
other ASCII than letters as blanks), chosen by their association with the category, as damped densities over the whole
text; each model is a ridge logistic regression fitted by Newton steps.

The training sample is bounded: PER_CLASS labelled ids of each class of the category named in STRATIFY, chosen by a hash of
the id, with texts up to LONGEST bytes, and BYTES bytes of each class altogether; of rows that share an id the least text is used, and of
labels that share an id the largest value of each category. Scoring covers every text, whole.

Edge cases: null text counts as empty; ids may be null or repeat, each row is scored by its text alone; rows of `labels` with
null, or without a document, are not used; with no labelled row, or one class only, a category gets its base rate as
constant probability, so an empty label table rejects nothing. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.llm import numtext
from veldspar.llm.store import table

#: (category, SQL over the columns of the label table), in chain order.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 AND quality = 0")]
REJECT, STRATIFY = "toxic", "toxic"
PER_CLASS, LONGEST, FOLDS, FEATURES = 1500, 1 << 20, 5, 250
#: Most bytes of text of each class; training takes some nine bytes for each.
BYTES = 24 << 20
GRAM, BITS = 5, 22

_NORM = np.full(256, 32, np.uint8)
_NORM[97:123] = np.arange(97, 123)
_NORM[65:91] = np.arange(97, 123)
_NORM[128:] = np.arange(128, 256)


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the 5-gram that starts at each byte (the last four bytes start none)."""
    b = _NORM[data].astype(np.uint64)
    n = max(len(b) - GRAM + 1, 0)
    v = np.zeros(n, np.uint64)
    for j in range(GRAM):
        v = (v << np.uint64(8)) | b[j : j + n]
    return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint32)


def densities(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.log1p(counts * (1000.0 / (sizes + 100.0))[:, None])


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack((x, np.ones((len(x), 1))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _best_limit(logit: np.ndarray, y: np.ndarray, base: float) -> float:
    """The probability, from 0.1 to 0.5, above which out-of-fold predictions have the best F1 at the base rate."""
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    weight = np.where(y > 0, base / y.mean(), (1 - base) / (1 - y.mean()))
    f1 = lambda t: 2 * weight[(p >= t) & (y > 0)].sum() / (weight[p >= t].sum() + weight[y > 0].sum())
    return max((f1(t), t) for t in np.arange(0.1, 0.501, 0.05))[1]


class Sample:
    """Distinct 5-gram buckets and their counts for each training text."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], float)
        # All texts in two arrays: thousands of small ones would leave the driver's memory in pieces.
        room = int(self.sizes.sum())
        self.buckets, self.counts, self.ends = np.empty(room, np.uint32), np.empty(room, np.uint32), np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            buckets, counts = np.unique(grams(np.frombuffer(t, np.uint8)), return_counts=True)
            at, end = self.ends[i], self.ends[i] + len(buckets)
            self.buckets[at:end], self.counts[at:end], self.ends[i + 1] = buckets, counts, end

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[i], self.ends[i + 1])
        return self.buckets[at], self.counts[at]

    def choose(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The buckets whose presence speaks most for the category, by the G statistic."""
        held = np.zeros((2, 1 << BITS), np.int32)  # texts with the bucket, by class
        for i, label in zip(rows, y.astype(int)):
            held[label, self.row(i)[0]] += 1
        buckets = np.flatnonzero(held.any(axis=0))
        neg, pos = held[:, buckets].astype(float)
        n, n1 = len(y), y.sum()
        a, b = pos + 0.5, neg + 0.5
        gain = 2 * (a * np.log(a * n / ((a + b) * n1)) + b * np.log(b * n / ((a + b) * (n - n1))))
        gain[(pos * (n - n1) <= neg * n1) | (pos < 3)] = -1
        best = np.argsort(-gain, kind="stable")[:FEATURES]
        return np.sort(buckets[best[gain[best] > 3.84]]).astype(np.uint32)

    def matrix(self, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), len(chosen)))
        for k, i in enumerate(rows):
            bucket, count = self.row(i)
            at = np.minimum(np.searchsorted(chosen, bucket), max(len(chosen) - 1, 0))
            hit = chosen[at] == bucket if len(chosen) else np.zeros(len(bucket), bool)
            x[k, at[hit]] = count[hit]
        return densities(x, self.sizes[rows])


class Chain:
    """Fitted chain: for each category the chosen buckets and weights, or a constant log-odds."""

    def __init__(self, names: list[str]):
        self.names, self.links, self._lookup, self.limits = names, [], None, {}

    def fit(self, sample: Sample, ys: np.ndarray, prior: dict[str, float], folds: np.ndarray) -> Chain:
        everyone, before = np.arange(len(ys)), np.zeros((len(ys), 0))
        for j, name in enumerate(self.names):
            y, base = ys[:, j].astype(float), prior[name]
            if not 0 < y.sum() < len(y):
                self.links.append((np.zeros(0, np.uint32), None, float(np.log((base + 1e-6) / (1 - base + 1e-6)))))
                before = np.hstack((before, np.full((len(y), 1), self.links[-1][2])))
                continue
            # The sample holds more of the rare class than the corpus does; the intercept is moved back.
            shift = np.log(base / (1 - base)) - np.log(y.mean() / (1 - y.mean())) if 0 < base < 1 else 0.0
            out = np.zeros(len(y))
            for f in range(FOLDS):
                rest, held = everyone[folds != f], everyone[folds == f]
                if not len(held):
                    continue
                if not 0 < y[rest].sum() < len(rest):
                    out[held] = np.log((base + 1e-6) / (1 - base + 1e-6))
                    continue
                chosen, w = self._one(sample, rest, y[rest], before[rest])
                out[held] = np.hstack((sample.matrix(held, chosen), before[held], np.ones((len(held), 1)))) @ w + shift
            chosen, w = self._one(sample, everyone, y, before)
            w[-1] += shift
            self.limits[name] = _best_limit(out, y, base)
            self.links.append((chosen, w, 0.0))
            before = np.hstack((before, np.clip(out, -6, 6)[:, None]))
        return self

    @staticmethod
    def _one(sample, rows, y, before):
        chosen = sample.choose(rows, y)
        return chosen, _newton(np.hstack((sample.matrix(rows, chosen), before)), y)

    def table(self) -> np.ndarray:
        """For each category a row: feature number of each bucket, or -1."""
        t = np.full((len(self.links), 1 << BITS), -1, np.int16)
        for j, (chosen, _, _) in enumerate(self.links):
            t[j, chosen] = np.arange(len(chosen))
        return t

    def score(self, column: pa.Array) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        if self._lookup is None:  # once for each worker: it isn't part of what is broadcast
            lookup = self.table()
            self._lookup = lookup, (lookup >= 0).any(axis=0)
        lookup, used = self._lookup
        out = []
        for _, data, off in numtext.blocks(column):
            bucket, sizes = grams(data), np.diff(off)
            at = np.flatnonzero(used[bucket])
            row = np.searchsorted(off, at, "right") - 1
            inside = at + GRAM <= off[row + 1]
            at, row = at[inside], row[inside]
            before, logits = np.zeros((len(sizes), 0)), []
            for j, (chosen, w, constant) in enumerate(self.links):
                if w is None:
                    logit = np.full(len(sizes), constant)
                else:
                    f = lookup[j, bucket[at]]
                    counts = np.bincount(row[f >= 0] * len(chosen) + f[f >= 0], minlength=len(sizes) * len(chosen)).reshape(len(sizes), len(chosen)) if len(chosen) else np.zeros((len(sizes), 0))
                    logit = np.hstack((densities(counts, sizes.astype(float)), before)) @ w[:-1] + w[-1]
                before = np.hstack((before, np.clip(logit, -6, 6)[:, None]))
                logits.append(logit)
            out.append(1 / (1 + np.exp(-np.clip(np.column_stack(logits), -30, 30))))
        return np.vstack(out) if out else np.zeros((0, len(self.links)))


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, stratify: str = STRATIFY, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on a bounded, stratified sample of the labelled documents; base rates come from all labels."""
    names = [n for n, _ in categories]
    flags = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), *[F.expr(f"cast({e} as int)").alias(n) for n, e in categories]).na.drop()
    rates = flags.agg(*[F.avg(n).alias(n) for n in names]).first()
    prior = {n: float(rates[n] or 0.0) for n in names}
    order = F.xxhash64("__id")
    labelled = flags.groupBy("__id").agg(*[F.max(n).alias(n) for n in names])  # of labels that disagree the larger one holds
    sizes = docs.select(F.col(id_col).alias("__id"), F.octet_length(text_col).cast("long").alias("__n")).filter(f"__n <= {LONGEST}")
    usable = labelled.join(sizes.groupBy("__id").agg(F.max("__n").alias("__n")), "__id")
    picked = [usable.filter(F.col(stratify) == v).orderBy(order, "__id").limit(per_class) for v in (0, 1)]
    few = picked[0].unionByName(picked[1])  # at most 2 * per_class rows
    bytes_so_far = F.sum("__n").over(W.partitionBy(stratify).orderBy(order, "__id").rowsBetween(W.unboundedPreceding, W.currentRow))
    sample = F.broadcast(few.withColumn("__b", bytes_so_far).filter(F.col("__b") <= BYTES).drop("__n", "__b"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(sample, "__id").filter(F.octet_length("__t") <= LONGEST)
    rows = rows.groupBy("__id", *names).agg(F.min("__t").alias("__t"))  # one row for each id
    got = rows.withColumn("__f", F.pmod(F.xxhash64(F.lit("fold"), F.col("__id")), F.lit(FOLDS))).orderBy(order, "__id").select("__t", "__f", *names).toArrow()
    texts, folds = [(t or "").encode() for t in got.column("__t").to_pylist()], got.column("__f").to_numpy().astype(int)
    ys = np.column_stack([got.column(n).to_numpy().astype(int) for n in names])
    return Chain(names).fit(Sample(texts), ys, prior, folds)


def _judge(spark: SparkSession, chain: Chain, threshold: float | None):
    """Function of a text column: a struct of the probabilities and `toxic`. Python gets the text alone and gives back numbers."""
    model = spark.sparkContext.broadcast(chain)
    reject, limit = chain.names.index(REJECT), chain.limits.get(REJECT, 0.5) if threshold is None else threshold
    names = [f"p_{n}" for n in chain.names]

    @F.arrow_udf(T.StructType([*[T.StructField(n, T.DoubleType()) for n in names], T.StructField("toxic", T.BooleanType())]))
    def judge(text: pa.Array) -> pa.Array:
        p = model.value.score(text)
        return pa.StructArray.from_arrays([*[pa.array(p[:, j]) for j in range(p.shape[1])], pa.array(p[:, reject] >= limit)], [*names, "toxic"])

    return judge


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with a probability for each category (p_<name>) and `toxic`, by `threshold` or the limit fitted out of fold.

    A column of `docs` that has the name of one of these is replaced.
    """
    added = [*[f"p_{n}" for n in chain.names], "toxic"]
    verdict = _judge(docs.sparkSession, chain, threshold)(F.col(text_col))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *[verdict[c].alias(c) for c in added])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """`docs` without the documents the chain rejects; columns stay as they are, whatever they are called."""
    judge = _judge(docs.sparkSession, fit_chain(docs, labels), threshold)
    return docs.filter(~judge(F.col("text"))["toxic"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdict for every document: doc_id, p_<category>, toxic, kept."""
    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs.select("doc_id", "text"), chain)
    return out.select("doc_id", *[f"p_{n}" for n in chain.names], "toxic", (~F.col("toxic")).alias("kept"))
