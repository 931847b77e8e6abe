"""The candidates most similar to each name among all candidates, by exact similarity, without scoring all pairs.

Distinct keys of names and candidates are dealt on a grid of cells, so that each key meets each candidate once, and a cell's texts
fit in memory at any size of the tables. In a cell, matching blocks are a common subsequence: the longest common subsequence of two
texts, taken for all candidates at once with bits for positions, bounds their ratio from above. Candidates are scored in order of
their bounds until no bound can beat the last of the best so far. The best of all cells are taken by score and ties.

The work is keys times candidates by nature; what is scored in full are the few that the bounds leave. Where no candidate is
similar, bounds are loose and many are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions.names import by_words, similarity
from veldspar.store import cut, rows

#: Names and candidates in a cell, and numbers of one table of positions. They decide speed and memory, not results.
NAMES, CANDIDATES, TABLE = 2048, 16384, 1 << 20
#: More than the rounding of a score to six digits takes away or adds.
MARGIN = 1e-6


class Positions:
    """For each character, the bits of its positions in each of many texts of at most 64 * `words` characters."""

    def __init__(self, texts: list[str], codes: dict[str, int], words: int):
        self.codes, self.words = codes, words
        self.bits = np.zeros((words, len(codes), len(texts)), np.uint64)
        size = np.array([len(x) for x in texts], np.int64)
        code = np.array([codes[x] for text in texts for x in text], np.int64)
        at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        np.bitwise_or.at(self.bits, (at // 64, code, np.repeat(np.arange(len(texts)), size)), np.uint64(1) << (at % 64).astype(np.uint64))

    def common(self, text: str, at: np.ndarray | None = None) -> np.ndarray:
        """Length of the longest common subsequence of `text` with each of the texts, or with those `at`."""
        n = self.bits.shape[2] if at is None else len(at)
        left = np.full((self.words, n), ~np.uint64(0))
        for code in filter(lambda c: c is not None, map(self.codes.get, text)):
            carry = None
            for w in range(self.words):
                here = self.bits[w, code] if at is None else self.bits[w, code, at]
                own = left[w]
                met = own & here
                total = own + met
                over = total < met
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if self.words > 1 else None
                left[w] = total | (own ^ met)
        return np.bitwise_count(~left).sum(0).astype(np.int64)


def _tables(keys: list[str]) -> Iterator[tuple[np.ndarray, Positions, Positions, np.ndarray, np.ndarray]]:
    """Parts of `keys`, each with the positions and lengths of its texts, as they are and by words; a table is of bounded size."""
    sorted_ = [by_words(k) for k in keys]
    words = np.array([max(1, -(-max(len(a), len(b)) // 64)) for a, b in zip(keys, sorted_)], np.int64)
    for w in np.unique(words).tolist():
        of = np.flatnonzero(words == w)
        codes = {x: i for i, x in enumerate(sorted({x for i in of for x in keys[i] + sorted_[i]}))}
        step = max(1, TABLE // (w * max(1, len(codes))))
        for i in range(0, len(of), step):
            at = of[i : i + step]
            texts = [keys[j] for j in at], [sorted_[j] for j in at]
            yield at, *[Positions(x, codes, w) for x in texts], *[np.array([len(y) for y in x], np.int64) for x in texts]


def _ratio(matched: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def _rounded(x: np.ndarray) -> np.ndarray:
    """As Python rounds, which numpy does not."""
    each, at = np.unique(x, return_inverse=True)
    return np.array([round(v, 6) for v in each.tolist()], float)[at]


class _Best:
    """The best candidates of one name so far, of distinct identifiers: (-combined, -character, position, token, identifier)."""

    def __init__(self, name: str, keys: list[str], frns: list[str], most: int):
        self.name, self.keys, self.frns, self.most = name, keys, frns, most
        self.held: list[tuple] = []
        self.scores: dict[str, tuple[float, float, float]] = {}

    def full(self) -> bool:
        return len(self.held) == self.most

    def take(self, i: int, bound: tuple | None = None) -> bool:
        """Score candidate `i` if its bound may count; False where neither it nor one with a worse bound does."""
        if bound and self.full() and bound >= self.held[-1][:3]:
            return False
        same = next((h for h in self.held if h[4] == self.frns[i]), None)
        if bound and same and bound >= same[:3]:
            return True
        if (key := self.keys[i]) not in self.scores:
            self.scores[key] = similarity(self.name, key)
        character, token, combined = self.scores[key]
        found = (-combined, -character, i, token, self.frns[i])
        if same is None or found < same:
            self.held = sorted([*[h for h in self.held if h is not same], found])[: self.most]
        return True


def best_of(names: list[str], keys: list[str], frns: list[str], most: int) -> list[list[tuple]]:
    """For each name the `most` best (-combined, -character, position, token, frn) of distinct frns; ties by position in `keys`."""
    best = [_Best(n, keys, frns, most) for n in names]
    for at, plain, sorted_, size, sorted_size in _tables(keys):
        for b in best:
            words = by_words(b.name)
            character = _ratio(plain.common(b.name), size + len(b.name))
            bound = 0.65 * character + 0.35 * _ratio(np.minimum(sorted_size, len(words)), sorted_size + len(words))
            if not b.full():  # for a first limit
                first = np.argsort(-bound, kind="stable")[: 4 * most]
                for i in at[first].tolist():
                    b.take(i)
            if b.full():
                may = np.flatnonzero(bound >= -b.held[-1][0] - MARGIN)
            else:
                may = np.arange(len(at))
            token = _ratio(sorted_.common(words, may), sorted_size[may] + len(words))
            combined, character = _rounded(0.65 * character[may] + 0.35 * token), _rounded(character[may])
            order = np.lexsort((at[may], -character, -combined))
            for c, s, i in zip((-combined[order]).tolist(), (-character[order]).tolist(), at[may][order].tolist()):
                if not b.take(i, (c, s, i)):
                    break
            b.scores.clear()
    return [b.held for b in best]


def closest(names: DataFrame, cand: DataFrame, tie: list[str], most: int) -> DataFrame:
    """(key, cid, s): for each key of `names` candidates among which are its `most` best of distinct `frn`, and their scores.

    `cand` (cid, ckey, frn, *tie) is a cut table, once for each cid. Scores tell keys alone apart: of the candidates of one key, the first of each
    identifier, and of these the first `most`, come before all others.
    """
    own = cut(names.select("key").filter("key IS NOT NULL").distinct(), "closest-names")
    one = cand.withColumn("__r", F.row_number().over(W.partitionBy("ckey", "frn").orderBy(*tie))).filter("__r = 1")
    few = one.withColumn("__r", F.row_number().over(W.partitionBy("ckey").orderBy(*tie))).filter(F.col("__r") <= most)
    few = cut(few.select("cid", "ckey", *dict.fromkeys(["frn", *tie])), "closest-candidates")
    down, across = (max(1, -(-rows(t) // n)) for t, n in ((own, NAMES), (few, CANDIDATES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # Cells are dealt by number: they are small in bytes, and adaptive execution would put many of them into one task.
    tasks = min(2 * down * across, 10_000)
    left = own.select("key", block("key", down).alias("a"), every(across).alias("b")).repartition(tasks, "a", "b")
    right = few.select("*", block("ckey", across).alias("b"), every(down).alias("a")).repartition(tasks, "a", "b")

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(tie, kind="stable").reset_index(drop=True)
        names_ = a["key"].tolist()
        cids = b["cid"].tolist()
        out = [(n, cids[i], -s, token, -c) for n, held in zip(names_, best_of(names_, b["ckey"].tolist(), b["frn"].tolist(), most)) for c, s, i, token, _ in held]
        return pd.DataFrame(out, columns=["key", "cid", "character", "token", "combined"]).astype({"cid": "int64"})

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(cell, "key string, cid long, character double, token double, combined double")
    return cut(met.select("key", "cid", F.struct("character", "token", "combined").alias("s")), "closest-scored")
