"""Connected components of a link table, by one path at every size: links are contracted where they lie, then alternating
large-star and small-star steps (Kiveris et al., 2014) join what the parts found.

Each task finds the components of its own links and gives back one link from every node to the least node of its component, which
is no more than it read; the steps over these few links end after some rounds. All nodes stay in the table, so that any round is a
forest over them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.store import cut

#: Links that a task contracts at a time, and so what it holds: 64 MB of ids. Longer partitions are contracted piece by piece.
PIECE = 1 << 22


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Point each node's neighbours (the larger ones, or the smaller ones and itself) to the least node it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    seen = both.join(least, "u")
    if larger:
        out = seen.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component): labels sink along links and jump along themselves."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, before = np.minimum(root[a], root[b]), root
        root = root.copy()
        for end in (a, b):
            np.minimum.at(root, end, low)
            np.minimum.at(root, before[end], low)  # the label that a node had sinks too
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def contracted(links: DataFrame, piece: int | None = None) -> DataFrame:
    """(u, v): for each task's links, every node but the least of its component with that least node."""
    most = piece or PIECE

    def forest(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        nodes, roots = labels(*(np.concatenate(x) for x in zip(*parts)))
        return nodes[nodes != roots], roots[nodes != roots]

    def batches(it):
        held, n = [], 0
        for b in it:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= most:  # what is found so far goes on as links; a forest is at most as long as its links
                found = forest(held)
                if len(found[0]) > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])
                    found = tuple(x[:0] for x in found)
                held, n = [found], len(found[0])
        if n:
            found = forest(held)
            for i in range(0, len(found[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 10_000]) for x in found], ["u", "v"])

    return links.select("u", "v").mapInArrow(batches, "u long, v long")


def components(links: DataFrame, rounds: int = 60, piece: int | None = None) -> DataFrame:
    """(node, root) for every node of `links` (u, v longs); root is the least node of the component. No links, no rows."""
    edges = cut(contracted(links.filter("u <> v"), piece).distinct(), "cc")
    state = None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        edges = cut(_stars(_stars(edges, True), False), "cc")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
