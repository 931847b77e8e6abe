"""Top-k search, importance resampling and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, oracle_rows, rows
from veldspar.llm import conversation_trie, importance_resample, topk_search
from veldspar.llm.store import cut, table


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- top-k ---------------------------------------------------------------------------------------------------------------


def brute_top_k(data, k, every, scale=1024.0):
    """From (id, vector) rows, with Python integers."""
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (qid, q) in enumerate(ok):
        if qid % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), cid) for j, (cid, c) in enumerate(ok) if j != at)[:k]
            out += [(qid, n, cid, -s) for n, (s, cid) in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells, queries, side", [(1 << 18, 1 << 15, 64), (600, 100, 2)])
def test_top_k_is_brute_force(spark, monkeypatch, cells, queries, side):
    monkeypatch.setattr(topk_search, "BLOCK_CELLS", cells)
    monkeypatch.setattr(topk_search, "QUERY_CELLS", queries)
    monkeypatch.setattr(topk_search, "SIDE", side)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 40))
    data = [(i, (centres[i % 5] + 0.3 * rng.normal(size=40)).tolist()) for i in range(400)]
    data += [(i, data[7][1]) for i in range(400, 480)]  # copies, so ties
    data += [(10, data[3][1]), (10, data[3][1]), (None, data[0][1]), (500, None), (501, [1.0, None]), (502, [math.nan] * 40), (503, [math.inf]), (510, []), (520, data[1][1][:7]), (530, [*data[2][1], 9.0, -9.0]), (-20, data[2][1]), (540, [-1e-9] * 40)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    got = topk_search.top_k(df, k=6, every=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert plain(got, *got.columns) == brute_top_k(data, 6, 10)


def test_top_k_of_large_integers(spark):
    rng = random.Random(1)
    data = [(i, [float(rng.randrange(-(10**6), 10**6)) for _ in range(20)]) for i in range(30)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert plain(topk_search.top_k(df, k=4, every=3, scale=100.0), "query_id", "rank", "vec_id", "score") == brute_top_k(data, 4, 3, 100.0)
    with pytest.raises(Exception, match="fit a long"):
        topk_search.top_k(df, k=4, every=3, scale=1e9).count()


def test_top_k_of_little(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(empty).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(one).collect() == []
    none = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(none).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [-0.0005])], "vec_id long, embedding array<float>")
    assert plain(topk_search.top_k(two), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, -1024)]


# ---- importance resampling -----------------------------------------------------------------------------------------------


def brute_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target):
    found = [brute_features(t) for _, t in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for _, f in found:
        for b in f:
            s[b] += 1
    for text in target:
        for b in brute_features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t)]
    out = []
    for (i, _), (n, f) in zip(docs, found):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r) for r in out), key=repr)


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank", "n_words")


def test_resample_is_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "The", "ÄPFEL", "x1", "naïve", "日本", "a", "w" * 47, "w" * 48, "w" * 49, "q" * 300, "z" * 70_000]
    text = lambda n: "".join(rng.choice(words[:10]) + rng.choice([" ", "  ", "\n", "-", "\x7f", "/", "`"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for i in range(500)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, " ".join(words)), (504, text(30_000)), (505, "é" * 3), (506, "a\x00b"), (-3, text(25))]
    target = [text(40) for _ in range(5)] + [None, "", "unseen words"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)).repartition(5)
    got = importance_resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert plain(got, *COLUMNS) == brute_resample(docs, target)


def test_resample_query_is_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    target = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    got = importance_resample.op12_importance_resample(spark, sf)
    assert [f.dataType.simpleString() for f in got.schema][:5] == ["bigint"] * 5
    assert plain(got, *COLUMNS) == brute_resample(docs, target)


def test_resample_ties_and_repeats(spark):
    """Rows that repeat an id and a text tie in everything; null ids share their noise and come last."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(i % 7, text) for i in range(70)] + [(None, text)] * 30 + [(9, None)] * 5
    got = importance_resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([], "text string"))
    assert plain(got, *COLUMNS) == brute_resample(docs, [])
    assert importance_resample.resample(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")).collect() == []


def test_cutoff_over_wide_scores(spark):
    rng = random.Random(2)
    values = [rng.choice([-(2**62), 2**62, 0, 1, rng.randrange(-(10**15), 10**15), rng.randrange(50)]) for _ in range(3000)]
    scores = cut(spark.createDataFrame([(v,) for v in values], "score long"))
    down = sorted(values, reverse=True)
    for wanted in (1, 2, 700, 1500, 2999, 3000):
        assert importance_resample.cutoff(scores, wanted) == down[wanted - 1]
    assert importance_resample.cutoff(scores, 0) is None and importance_resample.cutoff(scores, 3001) is None


def test_checksums_of_runs():
    """The look-up tables against zlib, over lengths that use several of their levels."""
    rng = np.random.default_rng(0)
    register = rng.integers(0, 2**32, 6, dtype=np.uint32)
    for n in (0, 1, 255, 256, 70_000):
        want = [zlib.crc32(b"\0" * n, int(r) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for r in register]
        assert importance_resample.zeros_after(register, np.full(6, n)).tolist() == want


# ---- conversation trie ---------------------------------------------------------------------------------------------------


def brute_trie(paths):
    """paths: {conv_id: [(role, text), ...]}"""
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        ends = sorted(c for c in own if len(paths[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children.get(key, [])), sum(k not in children for k in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_rebuilt(data):
    plain_turns = {}
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            plain_turns.setdefault(c, []).append(((turn is not None, turn or 0), role, key, text))
    turns = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in plain_turns.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return turns, {c: turns.get(c - int(math.fmod(c, 5)), [])[: heads[c]] + t[heads[c] :] for c, t in turns.items()}


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(rng, n, most):
    said = ["hi", "", "ok", "Ä", None, "x" * 50]
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in range(-8, n) if c % 11 for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed, n, most", [(1, 60, 5), (2, 40, 14), (3, 8, 30)])
def test_trie_is_brute_force(spark, seed, n, most):
    data = conversations(random.Random(seed), n, most)
    data += [(1000, t, "user", f"m{t}") for t in range(400)] + [(1001, t, "user", f"m{t}") for t in range(390)]  # long ones
    data += [(2000, None, "user", "first"), (2000, 5, "user", "tie"), (2000, 5, "user", "tie"), (2000, 5, "assistant", "tie"), (2000, 5, "user", "other"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("n_convs", F.lit(0)).repartition(3)
    turns, rebuilt = brute_rebuilt(data)
    got = conversation_trie.rebuilt_trie(df)
    assert tuple(got.columns) == NODE
    assert plain(got, *NODE) == brute_trie(rebuilt)
    assert plain(conversation_trie.conversation_trie(df), *NODE) == brute_trie(turns)


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([], schema)).collect() == []
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([(None, 0, "user", "a")], schema)).collect() == []
    data = [(c, 0, "user", "a") for c in range(1, 60) if c % 5]  # bases are absent: many conversations are left without turns
    _, rebuilt = brute_rebuilt(data)
    assert sum(not p for p in rebuilt.values()) > 3
    assert plain(conversation_trie.rebuilt_trie(spark.createDataFrame(data, schema)), *NODE) == brute_trie(rebuilt)


def test_trie_query_is_brute_force(spark, sf):
    data = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in table(spark, sf, "conversations").collect()]
    got = conversation_trie.op13_conversation_trie(spark, sf)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    assert plain(got, *NODE) == brute_trie(brute_rebuilt(data)[1])


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_importance_resample", "op13_conversation_trie"])
def test_sql(spark, sf, name):
    from veldspar.llm import catalog

    assert rows(catalog.QUERIES[name](spark, sf)) == oracle_rows(connect(sf), catalog.ORACLES[name])
