"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors.

1. Vectors become integers, floor(scale * x), and are packed into blocks in vertical layout: one row of the table holds the
   components of up to BLOCK_CELLS / dimensions vectors, dimension after dimension. Queries are packed likewise.
2. Every query gets a lower bound of its k-th best score from one block of candidates, which is broadcast (BLOCK_CELLS numbers).
3. Candidate blocks and query blocks are dealt on a grid of cells, at most SIDE blocks by SIDE blocks, by an equi join on the
   cell: each block of one side meets each of the other once. A cell's blocks fit in memory at any size of the table.
4. In a pair of blocks, scores are accumulated dimension block by dimension block. After each, a candidate stays with a query only
   if what it has, plus the largest inner product that the remaining masses (norms over the dimensions left) allow, reaches the
   query's k-th best so far; survivors are compacted, and only their columns are read on. The k best of a cell leave it.
5. The k best of all cells are taken by score and id.

A score can only be missed if its bound lies below k scores that exist, so the search is exact; the seed block decides speed alone.

Edge cases: a vector that is null, or holds a null or non-finite component, takes no part, nor does a row without an id. Vectors of
different lengths meet as if the shorter had zeros behind it; an empty vector scores 0. Rows that repeat an id, or id and vector, are
rows of their own: each takes part, and a query leaves out its own row only. Ties go to the smaller id. An empty table gives an
empty result. A component of 2^53 or more in size, or scores that don't fit 63 bits, are an error, since no long can hold them.
Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.llm.store import cut, passing, rows, short_batches, table

#: Components of one block of candidates and of one block of queries, and blocks of each side in a cell of the grid.
BLOCK_CELLS, QUERY_CELLS, SIDE = 1 << 18, 1 << 15, 64
#: Dimensions that are accumulated between two looks at the bounds.
STEP = 16
_BLOCK = "block long, n int, d int, ids array<long>, cells binary"
_ARROW = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, all their components as integers, row after row) of a list column."""
    off = np.asarray(column.offsets, np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    good = np.asarray(column.is_valid())
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    at = np.flatnonzero(good & (bad[off[1:]] == bad[off[:-1]]))
    lengths = (off[1:] - off[:-1])[at]
    inside = np.repeat(off[at] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    x = np.floor(scale * flat[inside])
    if len(x) and np.abs(x).max() >= 2.0**53:
        raise ValueError("a component is too large for exact integer scores")
    return at, lengths, x.astype(np.int64)


def _vertical(lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Matrix of dimensions x vectors, zeros behind the end of the shorter ones."""
    d = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d)[None, :] < lengths[:, None]] = flat
    return np.ascontiguousarray(out.T)


def _record(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], ["block", "n", "d", "ids", "cells"])


def _packed(vectors: DataFrame, scale: float, most: int) -> DataFrame:
    """`vectors` (id, v) as blocks of at most `most` components in vertical layout."""

    def pack(batches):
        from pyspark import TaskContext

        number, held, room = TaskContext.get().partitionId() << 32, [], 0

        def block():
            nonlocal number, held, room
            ids = np.concatenate([h[0] for h in held])
            m = _vertical(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            row = _record([[number], [len(ids)], [m.shape[0]], [ids], [m.astype("<i8").tobytes()]])
            number, held, room = number + 1, [], 0
            return row

        for b in batches:
            at, lengths, flat = integers(b.column(1), scale)
            ids = b.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            i = 0
            while i < len(ids):
                # As many rows as fit; empty vectors take room too.
                j = max(i + 1, int(np.searchsorted(ends + np.arange(len(ends)), ends[i] + i + most - room, "right")) - 1)
                if held and j == i + 1 and room + ends[j] - ends[i] + 1 > most:
                    yield block()
                    continue
                held.append((ids[i:j], lengths[i:j], flat[ends[i] : ends[j]]))
                room, i = room + int(ends[j] - ends[i]) + j - i, j
                if room >= most:
                    yield block()
        if held:
            yield block()

    return vectors.mapInArrow(pack, _BLOCK)


def _unpacked(block, n, d, cells) -> np.ndarray:
    return np.frombuffer(cells, "<i8").reshape(d, n)


class _Side:
    """A block as floating-point numbers, which hold these integers exactly, with the masses that are left after each step."""

    def __init__(self, m: np.ndarray, ids: np.ndarray):
        self.m, self.ids = m.astype(np.float64), ids
        mass = np.vstack([(self.m[s : s + STEP] ** 2).sum(axis=0) for s in range(0, max(len(m), 1), STEP)])
        self.left = np.sqrt(np.vstack([np.cumsum(mass[::-1], axis=0)[::-1][1:], np.zeros((1, m.shape[1]))]))
        self.largest = int(np.abs(m).max(initial=0))


def _exact(q: _Side, c: _Side) -> bool:
    """Whether floating-point sums are exact; else the pair is scored in integers."""
    most = q.largest * c.largest * min(len(q.m), len(c.m))
    if most >= 2**63:
        raise ValueError("scores don't fit a long")
    return most < 2**53


def best_of(q: _Side, c: _Side, least: np.ndarray, k: int, own: np.ndarray | None = None, whole: tuple | None = None):
    """For each query, (columns, scores) of candidates that may be among its k best, given the k-th best known `least`.

    `own`: for each query its own column, or -1. `whole`: both sides as integers, for scores that need them.
    """
    d = min(len(q.m), len(c.m))
    exact = _exact(q, c)
    steps = list(range(0, d, STEP)) or [0]
    first = min(STEP, d)
    part = q.m[:first].T @ c.m[:first] if first else np.zeros((q.m.shape[1], c.m.shape[1]))
    for i in range(q.m.shape[1]):
        have, at = part[i], None  # at: the columns that are left, None for all
        for step in range(len(steps)):
            if step:
                block = slice(steps[step], min(steps[step] + STEP, d))
                have = have + q.m[block, i] @ (c.m[block] if at is None else c.m[block][:, at])
            # Rounding of the bound itself is far below its slack.
            bound = have + q.left[step, i] * (c.left[step] if at is None else c.left[step][at]) * (1 + 1e-9) + (0 if exact else np.abs(have) * 1e-9 + 1)
            alive = np.flatnonzero(bound >= least[i])
            if len(alive) < len(have):
                have, at = have[alive], alive if at is None else at[alive]
            if not len(have):
                break
        at = np.arange(len(have)) if at is None else at
        if own is not None and own[i] >= 0:
            keep = at != own[i]
            at, have = at[keep], have[keep]
        scores = have.astype(np.int64) if exact else whole[0][:d, i] @ whole[1][:d, at]
        if len(scores) > k:
            order = np.lexsort((c.ids[at], -scores))[:k]
            at, scores = at[order], scores[order]
        yield at, scores


def _sides(row: dict, prefix: str) -> tuple[_Side, np.ndarray]:
    m = _unpacked(row[f"{prefix}block"], row[f"{prefix}n"], row[f"{prefix}d"], row[f"{prefix}cells"])
    return _Side(m, np.asarray(row[f"{prefix}ids"], np.int64)), m


def _seeded(queries: DataFrame, seed, k: int) -> DataFrame:
    """Query blocks with `least`: for each query the k-th best score in the seed block, or the smallest long."""

    def look(batches):
        c, whole = _sides(seed.value, "")
        for b in batches:
            for row in b.to_pylist():
                q, ints = _sides(row, "")
                own = np.where(np.array(row["from_block"]) == seed.value["block"], np.array(row["from_at"]), -1)
                least = np.full(row["n"], np.iinfo(np.int64).min)
                for i, (_, s) in enumerate(best_of(q, c, np.full(row["n"], -np.inf), k, own, (ints, whole))):
                    if len(s) == k:
                        least[i] = s.min()
                yield pa.RecordBatch.from_arrays([*[pa.array([row[f.name]], f.type) for f in b.schema], pa.array([least], pa.list_(pa.int64()))], [*b.schema.names, "least"])

    return queries.mapInArrow(look, f"{_BLOCK}, from_block array<long>, from_at array<int>, least array<long>")


def _query_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """The vectors of `blocks` whose id is divisible by `every`, packed again, with the place of each: from_block, from_at."""

    def pick(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = np.array(row["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    m = _unpacked(row["block"], row["n"], row["d"], row["cells"])
                    cells = [np.ascontiguousarray(m[:, i]).tobytes() for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([row["block"]] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(cells, pa.binary())], ["id", "from_block", "from_at", "cells"])

    def pack(batches):
        from pyspark import TaskContext

        number, held, room = TaskContext.get().partitionId() << 32, [], 0

        def block():
            nonlocal number, held, room
            vectors = [np.frombuffer(h[3], "<i8") for h in held]
            m = _vertical(np.array([len(v) for v in vectors]), np.concatenate(vectors))
            row = _record([[number], [len(held)], [m.shape[0]], [[h[0] for h in held]], [m.tobytes()]])
            row = pa.RecordBatch.from_arrays([*row.columns, pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([[h[2] for h in held]], pa.list_(pa.int32()))], [*row.schema.names, "from_block", "from_at"])
            number, held, room = number + 1, [], 0
            return row

        for b in batches:
            for h in zip(*[c.to_pylist() for c in b.columns]):
                held.append(h)
                room += len(h[3]) // 8 + 1
                if room >= QUERY_CELLS:
                    yield block()
        if held:
            yield block()

    singles = cut(blocks.mapInArrow(pick, "id long, from_block long, from_at int, cells binary"), "topk-queries")
    cells = singles.agg(F.sum(F.octet_length("cells"))).first()[0] or 0
    return singles.repartition(max(1, -(-cells // (8 * QUERY_CELLS)))).mapInArrow(pack, f"{_BLOCK}, from_block array<long>, from_at array<int>")


def _searched(cells: DataFrame, k: int) -> DataFrame:
    """The k best (from_block, from_at, query_id, vec_id, score) of each query in each cell; rows of a cell come one after the other."""

    def search(batches):
        names = ["from_block", "from_at", "query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        cell, found, sides = None, {}, {}

        def flush():
            for q, least, best, row in found.values():
                got = [(fb, fa, qid, v, s) for fb, fa, qid, b in zip(row["q_from_block"], row["q_from_at"], row["q_ids"], best) for s, v in b]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names)

        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in ("g", "r", "c_block", "q_block")}
                if (row["g"], row["r"]) != cell:
                    yield from flush()
                    cell, found, sides = (row["g"], row["r"]), {}, {}
                if row["c_block"] not in sides:  # a candidate block meets all query blocks in a row
                    sides = {row["c_block"]: _sides({n: b.column(n)[i].as_py() for n in b.schema.names if n.startswith("c_")}, "c_")}
                if row["q_block"] not in found:
                    new = {n: b.column(n)[i].as_py() for n in b.schema.names if n.startswith("q_")}
                    found[row["q_block"]] = (_sides(new, "q_"), np.array(new["q_least"], np.int64), [[] for _ in range(new["q_n"])], new)
                (c, c_ints), ((q, q_ints), least, best, held) = sides[row["c_block"]], found[row["q_block"]]
                own = np.where(np.array(held["q_from_block"]) == row["c_block"], np.array(held["q_from_at"]), -1)
                for j, (at, scores) in enumerate(best_of(q, c, least, k, own, (q_ints, c_ints))):
                    if len(at):
                        best[j] = sorted([*best[j], *zip(scores.tolist(), c.ids[at].tolist())], key=lambda x: (-x[0], x[1]))[:k]
                        if len(best[j]) == k:
                            least[j] = max(least[j], best[j][-1][0])
        yield from flush()

    return cells.mapInArrow(search, "from_block long, from_at int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each vector whose id is divisible by `every`, the k best others."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    source = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    with passing(), short_batches(spark, most=8 << 20):
        blocks = cut(_packed(source, scale, BLOCK_CELLS), "topk-blocks")
        fullest = blocks.agg(F.max_by("block", F.struct("n", "block"))).first()[0]
        if fullest is None:
            return empty
        seed = blocks.filter(F.col("block") == fullest).collect()  # one row
        shared = spark.sparkContext.broadcast(seed[0].asDict())
        queries = cut(_seeded(_query_blocks(blocks, every), shared, k), "topk-queryblocks")
        n_c, n_q = rows(blocks), rows(queries)
        if not n_q:
            return empty
        # Enough cells for all cores, and no more than SIDE blocks on a side of one.
        g = max(-(-n_c // SIDE), min(n_c, 2 * spark.sparkContext.defaultParallelism))
        r = -(-n_q // SIDE)
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        c = blocks.select(dealt("block", g).alias("g"), each(r).alias("r"), *[F.col(x).alias(f"c_{x}") for x in blocks.columns])
        q = queries.select(each(g).alias("g"), dealt("block", r).alias("r"), *[F.col(x).alias(f"q_{x}") for x in queries.columns])
        parts = min(g * r, 20_000)
        cells = c.repartition(parts, "g", "r").join(q.repartition(parts, "g", "r").hint("merge"), ["g", "r"])
        best = cut(_searched(cells, k), "topk-best", keep=True)
        shared.unpersist()
    order = W.partitionBy("from_block", "from_at").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others, by integer inner product, of every hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.row, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""
