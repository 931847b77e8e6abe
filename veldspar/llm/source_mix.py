"""Mixing sources to target weights by soft membership.

A softmax classifier trained on labelled rows predicts, for every document, posteriors over domains. Documents then
get nonnegative rates w so that the expected tokens of domain k, S_k = sum_d w_d * tokens_d * p_dk, match targets T_k.
The rates minimise the squared misses, each scaled by its domain, by projected gradient steps from w = 1:
w_d <- max(0, w_d + step * sum_k p_dk * (T_k - S_k) / N_k) with N_k = sum_d tokens_d * p_dk^2.

Each step is one distributed sum of as many numbers as there are domains. A document's rate follows from its posterior and
the short history of steps alone, so nothing of the size of the corpus is rewritten from step to step, and a lost
executor costs only its own partitions. Texts are scored once for this; the steps read the small table of posteriors. Features are hashed byte trigrams of the whole text, as shares.

The domain is a column of the documents (`lang` in the query: in these tables the ids of sources leave no trace in the text,
so posteriors over them would be flat and no rates could tell them apart). The classifier is fitted on at most SAMPLE
labelled ids, chosen by a hash of the id (of rows that share an id the least counts), and on rows of each domain that occurs in no such row; counts, posteriors and rates
cover every document.

Edge cases: null or blank text has 0 tokens and counts for nothing, its rate follows from its posterior; a null domain is
no training row; ids may be null or repeat; a domain without a target has target 0, a target without a document is
warned of and can't be met; a domain without a text of at most LONGEST bytes is an error; without any domain all is one
domain named "all"; an empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import json
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import numtext
from veldspar.llm.store import cut, passing, short_batches, table

#: Target shares of all tokens, and the tokens asked for as a multiple of those there are.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
TOTAL = 1.0
SAMPLE, LONGEST, BUCKETS = 2000, 1 << 20, 1024
#: Most domains: K squared sums are made at a time.
DOMAINS = 64
STEPS, CLOSE = 60, 1e-6


def _shares(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of hashed byte trigrams, a row for each text."""
    n, b = len(off) - 1, numtext._LOWER[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros((n, BUCKETS))
    v = ((b[:-2] | (b[1:-1] << 8) | (b[2:] << 16)) * np.uint32(2654435761)) >> np.uint32(22)
    row = np.repeat(np.arange(n), np.diff(off))[: len(v)]
    counts = np.bincount(row * BUCKETS + v, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return counts / np.maximum(np.diff(off), 1)[:, None]


class DomainModel:
    """Softmax regression on trigram shares."""

    def __init__(self, domains: list[str]):
        self.domains, self.w = domains, np.zeros((BUCKETS + 1, max(len(domains), 1)))

    def fit(self, texts: list[str], y: np.ndarray, rounds: int = 300) -> DomainModel:
        x = np.vstack([self._x(*part[1:]) for part in numtext.blocks(pa.array(texts, pa.large_string()))])
        target, speed, self.w = np.eye(len(self.domains))[y], np.zeros_like(self.w), np.zeros_like(self.w)
        for _ in range(rounds):
            gradient = x.T @ (self._softmax(x @ self.w) - target) / len(y) + 1e-4 * self.w
            speed = 0.9 * speed - 0.5 * gradient
            self.w = self.w + speed
        return self

    @staticmethod
    def _x(data, off):
        s = np.sqrt(_shares(data, off))
        return np.hstack((s * 4, np.ones((len(s), 1))))

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of each text."""
        tokens, post = [np.zeros(0, np.int64)], [np.zeros((0, self.w.shape[1]))]
        for _, data, off in numtext.blocks(column):
            word = ~numtext._BLANK[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[off] = True
            starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1])))) if len(data) else np.zeros(0, np.int64)
            tokens.append(np.diff(np.searchsorted(starts, off)))
            post.append(self._softmax(self._x(data, off) @ self.w))
        return np.concatenate(tokens), np.vstack(post)


def fit_domains(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DomainModel:
    ids = labels.select(F.col(id_col).alias("__id")).filter("__id IS NOT NULL").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id"), "left_semi").filter(F.octet_length(text_col) <= LONGEST)
    one = rows.select(F.col(id_col).alias("i"), F.col(domain_col).cast("string").alias("d"), F.col(text_col).alias("t")).na.drop().groupBy("i").agg(F.min(F.struct("d", "t")).alias("m"))
    got = one.select("i", "m.d", "m.t").orderBy("i").toArrow().to_pylist()  # one row for each of the ids
    # A domain that the sample misses is trained on rows of its own, labelled or not; such domains are few and rare.
    occurring = [r["d"] for r in docs.filter(F.col(text_col).isNotNull()).select(F.col(domain_col).cast("string").alias("d")).distinct().na.drop().limit(DOMAINS + 1).collect()]
    if len(occurring) > DOMAINS:
        raise ValueError(f"column {domain_col!r} has more than {DOMAINS} values: it names no domains")
    for d in sorted(set(occurring) - {r["d"] for r in got}):
        own = docs.filter(F.col(domain_col).cast("string") == d).select(F.col(id_col).alias("i"), F.lit(d).alias("d"), F.col(text_col).alias("t"))
        more = own.filter(F.octet_length("t") <= LONGEST).orderBy(F.xxhash64("t"), "t").limit(max(1, sample // len(occurring))).collect()
        if not more:
            raise ValueError(f"domain {d!r} has no text to train on")
        got += more
    domains = sorted({r["d"] for r in got}) or ["all"]
    model = DomainModel(domains)
    return model.fit([r["t"] for r in got], np.array([domains.index(r["d"]) for r in got])) if got else model


def rate(p: Column, history: np.ndarray) -> Column:
    """A document's rate from its posteriors: the steps of the history in turn, never below 0."""
    if not len(history):
        return F.lit(1.0)
    steps = F.from_json(F.lit(json.dumps(np.asarray(history).tolist())), "array<array<double>>")
    move = lambda step: F.aggregate(F.zip_with(p, step, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.lit(1.0), lambda w, step: F.greatest(F.lit(0.0), w + move(step)))


def fit_rates(scored: DataFrame, domains: list[str], targets: dict[str, float], total: float = TOTAL, steps: int = STEPS) -> np.ndarray:
    """The history of steps (a row for each), from `scored` (n_tokens, p)."""
    k = len(domains)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    sums = scored.agg(F.sum("n_tokens").alias("all"), *[F.sum(F.col("n_tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    everything = float(sums["all"] or 0)
    if not everything:
        return np.zeros((0, k))
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    n = np.maximum(np.diag(gram), 1e-9 * everything)
    step = 1 / np.linalg.eigvalsh(gram / np.sqrt(np.outer(n, n))).max()
    target = np.array([targets.get(d, 0.0) for d in domains]) * total * everything
    history = np.zeros((0, k))

    def expected(taken: np.ndarray) -> np.ndarray:
        drawn = scored.select((F.col("n_tokens") * rate(F.col("p"), taken)).alias("w"), "p")
        got = drawn.agg(*[F.sum(F.col("w") * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
        return np.array([x or 0.0 for x in got])

    for _ in range(steps):
        miss = target - expected(history)
        if np.abs(miss).max() <= CLOSE * everything:
            break
        history = np.vstack((history, step * miss / n))
    return history


def _score(spark: SparkSession, model: DomainModel):
    """Function of a text column: a struct of n_tokens and p. Python gets the text alone and gives back numbers."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n_tokens:bigint,p:array<double>>")
    def score(text: pa.Array) -> pa.Array:
        tokens, post = shared.value.predict(text)
        offsets = pa.array(np.arange(len(post) + 1, dtype=np.int32) * post.shape[1], pa.int32())
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(post.ravel()))], ["n_tokens", "p"])

    return score


def score_domains(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """The columns of `docs` but its text, with n_tokens and p (posteriors in the order of model.domains)."""
    s = _score(docs.sparkSession, model)(F.col(text_col))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_tokens", "p")], s["n_tokens"].alias("n_tokens"), s["p"].alias("p"))


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain_col: str = "lang", total: float = TOTAL, id_col: str = "doc_id") -> tuple[DomainModel, np.ndarray, DataFrame]:
    """The classifier, the history of steps, and the scored documents (doc_id, n_tokens, p), a cut table."""
    model = fit_domains(docs, labels, domain_col, id_col)
    if absent := sorted(d for d, share in targets.items() if share and d not in model.domains):
        warnings.warn(f"no document has the target domains {absent}", stacklevel=2)
    with short_batches(docs.sparkSession):
        scored = cut(score_domains(docs.select(F.col(id_col).alias("doc_id"), "text"), model), "mix-scored")
    return model, fit_rates(scored, model.domains, targets, total), scored


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain_col: str = "lang", total: float = TOTAL) -> DataFrame:
    """`docs` with n_tokens and rate: how often a document is to be drawn in an epoch of the mixture.

    Columns of `docs` with these names are replaced. Rows are scored in place, by their own text, so that texts are never
    shuffled and rows without an id, or that share one, get their own rates.
    """
    with passing():
        model, history, _ = mix_sources(docs, labels, targets, domain_col, total)
    s = _score(docs.sparkSession, model)(F.col("text"))
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "rate")], s.alias("__scored"))
    return out.withColumns({"n_tokens": F.col("__scored.n_tokens"), "rate": rate(F.col("__scored.p"), history)}).drop("__scored")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, likeliest domain, posteriors and rate."""
    model, history, scored = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    best = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position("p", F.array_max("p")).cast("int"))
    return scored.select("doc_id", "n_tokens", best.alias("domain"), F.array_max("p").alias("posterior"), F.col("p").alias("posteriors"), rate(F.col("p"), history).alias("rate"))
