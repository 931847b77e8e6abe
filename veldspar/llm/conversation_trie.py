"""The trie of all prefixes of conversations: sharing, children, leaves and what shared prefixes save.

1. Turns become digests of (role, text) and lengths; texts stay where they are.
2. Prefix digests are chained, SHA-256 of the prefix before and the turn's digest, along each conversation, in rows that are sorted
   by conversation and place and read as a stream: what a task holds is one digest, however long the conversation.
3. Every prefix is a row; rows are grouped by (depth, digest) into nodes, with partial sums before the shuffle.
4. A node belongs to the least of its members. Members become fewer with depth, so what a conversation owns is the end of its path:
   the nodes from some depth on. Above that its path runs through nodes of smaller conversations.
5. Subtree sums: the nodes of each owner are exploded to all owners above them, with the depth at which the path leaves these; summed
   there, and then upwards along the owner's own path. Rows of this step are no more than prefixes, however deep the trie is, since
   nodes of one owner go up together.

The root, which every conversation shares, is made by itself and never grouped by digest.

Edge cases: null role or text counts as empty; a null turn comes first; turns that tie are ordered by role and by the text's digest, so
repeated rows are turns of their own; rows without a conv_id belong to no conversation and take no part; an empty table has no
conversations, and so gives no nodes, not even a root. A conversation without turns (rebuilding can leave one) is a member of the root only.
Extra columns are not looked at. The digest of the ids that end in a node is a stream over these ids in order: one task for a node,
which holds one id at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.llm.store import cut, hinted, passing, table

#: Turns that may come from another conversation when conversations are rebuilt: fewer than this.
HEADS = 9
EMPTY = hashlib.sha256(b"").hexdigest()


def digested(rows: DataFrame) -> DataFrame:
    """(conv_id, k, turn_digest, n_bytes): the turns of each conversation, numbered from 1."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # no two pairs of role and text read alike
    light = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(turn, 256)).alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_digest")
    return light.select("conv_id", F.row_number().over(order).alias("k"), "turn_digest", "n_bytes")


def heads_taken(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its five."""
    return (F.crc32(F.encode(conv_id.cast("string"), "utf-8")) % HEADS).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, turns): each conversation as the first turns of another one and its own later turns; `part` 0 comes before 1."""
    ids = turns.filter("k = 1").select("conv_id", heads_taken(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    first = turns.filter(F.col("k") < HEADS).withColumnRenamed("conv_id", "base")
    taken = ids.join(first, "base").filter("k <= h").select("conv_id", F.lit(0).alias("part"), "k", "turn_digest", "n_bytes")
    own = turns.filter(F.col("k") > heads_taken(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "k", "turn_digest", "n_bytes")
    return ids.select("conv_id"), taken.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, n_bytes, last): every non-empty prefix of every conversation; `last`: it is the whole conversation."""
    schema = "conv_id long, depth int, digest binary, n_bytes long, last boolean"
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
    names = ["conv_id", "depth", "digest", "n_bytes", "last"]

    def chain(batches):
        conv, depth, state, waiting = None, 0, b"", None
        for b in batches:
            ids, sizes = b.column(0).to_numpy(zero_copy_only=False), b.column(4).to_pylist()
            depths, states = [], []
            for c, turn in zip(ids.tolist(), b.column(3).to_pylist()):
                if c != conv:
                    conv, depth, state = c, 0, b""
                depth, state = depth + 1, hashlib.sha256(state + turn).digest()
                depths.append(depth)
                states.append(state)
            if not depths:
                continue
            if waiting is not None:  # the last row of a batch waits for the next, which tells whether it ends its conversation
                waiting[4] = [waiting[0][0] != ids[0]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(waiting, kinds)], names)
            last = ids[:-1] != ids[1:]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids[:-1], depths[:-1], states[:-1], sizes[:-1], last), kinds)], names)
            waiting = [ids[-1:], depths[-1:], states[-1:], sizes[-1:], [True]]
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(waiting, kinds)], names)

    return turns.select("conv_id", "part", "k", "turn_digest", "n_bytes").repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").mapInArrow(chain, schema)


def _ends(last: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) from the ids that end in each node, (depth, digest, conv_id)."""

    def stream(batches):
        node, state = None, None
        for b in batches:
            out = []
            for key, c in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist()):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(str(c).encode())
                else:
                    state.update(b",%d" % c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), kinds)], names)

    kinds, names = [pa.int32(), pa.binary(), pa.string()], ["depth", "digest", "ends_sha256"]
    return last.select("depth", "digest", "conv_id").repartition("depth", "digest").sortWithinPartitions("depth", "digest", "conv_id").mapInArrow(stream, "depth int, digest binary, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node. `ids` (conv_id): all conversations, once each; `turns` (conv_id, part, k, turn_digest, n_bytes)."""
    with passing():
        return cut(_trie(ids, turns), "trie", keep=True)


def _trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    n_all, top = ids.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not n_all:
        return ids.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    paths = cut(prefixes(turns), "trie-prefixes")
    grouped = paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.count_if("last").alias("n_ends"))
    ends = _ends(paths.filter("last"))
    nodes = cut(grouped.join(ends, ["depth", "digest"], "left").withColumn("own", F.greatest(F.lit(0), F.col("n_convs") - 1) * F.col("n_bytes")), "trie-nodes")
    # The root: the least conversation owns it, and those without turns end there.
    bare = ids.join(paths.filter("last").select("conv_id"), "conv_id", "left_anti")
    bare_ends = _ends(bare.select(F.lit(0).alias("depth"), F.lit(b"").alias("digest"), "conv_id")).select("ends_sha256").first()  # one node
    root = ids.sparkSession.createDataFrame([(0, top, n_all, 0, bare_ends[0] if bare_ends else EMPTY)], "depth int, conv_id long, n_convs long, own long, ends_sha256 string")
    light = cut(nodes.select(root.columns).unionByName(root), "trie-light")

    # What each owner has: its nodes lie from `a` to `z` on its path.
    owners = cut(light.groupBy("conv_id").agg(F.min("depth").alias("a"), F.max("depth").alias("z"), F.sum("own").alias("saved")), "trie-owners")
    # Nodes shared with a smaller conversation: each is exploded to the owners above, with the depth at which the path leaves them.
    shared = nodes.filter("n_convs > 1").select("depth", "digest", F.col("conv_id").alias("above"))
    shared = cut(shared, "trie-shared")
    begun = hinted(owners.select("conv_id", "a").filter("a > 0"), of=owners)
    upper = paths.select("conv_id", "depth", "digest").join(begun, "conv_id").filter("depth < a").join(hinted(shared), ["depth", "digest"]).select("conv_id", "a", "above", "depth")
    to_root = owners.filter("a > 0").select("conv_id", "a", F.lit(top).alias("above"), F.lit(0).alias("depth"))
    above = cut(upper.unionByName(to_root).groupBy("conv_id", "above").agg(F.max("depth").alias("depth"), F.first("a").alias("a")), "trie-above")
    children = cut(above.filter("depth = a - 1").groupBy(F.col("above").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("kids")), "trie-children")
    ended = owners.join(children.withColumnRenamed("depth", "z"), ["conv_id", "z"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    value = owners.select("conv_id", "saved").join(ended, "conv_id", "left").select("conv_id", "saved", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    value = cut(value, "trie-values")
    below = above.join(value, "conv_id").groupBy(F.col("above").alias("conv_id"), "depth").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    parents = above.filter("depth = a - 1").select("conv_id", F.col("a").alias("depth"), F.col("above").alias("parent"))

    full = light.join(owners.select("conv_id", "a", "z"), "conv_id").join(children, ["conv_id", "depth"], "left").join(below, ["conv_id", "depth"], "left").join(parents, ["conv_id", "depth"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    full = full.withColumn("n_children", (zero("kids") + (F.col("depth") < F.col("z")).cast("long")))
    upwards = W.partitionBy("conv_id").orderBy(F.desc("depth"))  # along the owner's path, from its end
    return full.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.sum(zero("leaves") + (F.col("n_children") == 0).cast("long")).over(upwards).alias("n_leaves"),
        F.sum(zero("saved") + F.col("own")).over(upwards).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations as they are: rows (conv_id, turn, role, text)."""
    with passing():
        turns = cut(digested(rows), "trie-turns")
        return cut(_trie(turns.filter("k = 1").select("conv_id"), turns.withColumn("part", F.lit(0))), "trie", keep=True)


def rebuilt_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations that are rebuilt first, see `rebuilt`."""
    with passing():
        ids, turns = rebuilt(cut(digested(rows), "trie-turns"))
        return cut(_trie(ids, turns), "trie", keep=True)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(t)) AS k, t, n FROM t),
h AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT h.conv_id, 0 AS part, k, t, n FROM h JOIN o ON o.conv_id = h.base AND k <= h
  UNION ALL SELECT h.conv_id, 1, k, t, n FROM h JOIN o ON o.conv_id = h.conv_id AND k > h
), l AS (SELECT conv_id, list(t ORDER BY part, k) AS p, list(n ORDER BY part, k) AS b FROM r GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(p, CAST([] AS VARCHAR[])) AS p, b FROM h LEFT JOIN l USING (conv_id)),
x AS (SELECT conv_id, d, p[1:d] AS key, CASE WHEN d = 0 THEN 0 ELSE b[d] END AS n, d = len(p) AS ends FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM c)),
v AS (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM x GROUP BY d, key
), k AS (SELECT v.d, v.key, p.conv_id AS parent, v.conv_id, v.n_convs, v.own, v.ends_sha256 FROM v LEFT JOIN v p ON p.d = v.d - 1 AND p.key = v.key[1:v.d - 1]),
a AS (SELECT d, key, (SELECT count(*) FROM k y WHERE y.d = k.d + 1 AND y.parent = k.conv_id) AS n_children FROM k),
f AS (SELECT k.*, n_children FROM k JOIN a USING (d, key)),
s AS (SELECT e.d, e.key[1:e.d] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT key, n_children, own, unnest(range(0, d + 1)) AS d FROM f) e GROUP BY ALL)
SELECT conv_id, f.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM f JOIN s USING (d, key)
"""
