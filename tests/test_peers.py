"""Peer ranks, counts and quantiles of groups of any size."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from veldspar.plans import peers, scan


def _rows(seed=1, n=900):
    rng = random.Random(seed)
    group = lambda: rng.choice([("p1", "hot")] * 4 + [("p1", None), ("p2", "hot"), ("p2", "x"), (None, "y")])
    number = lambda: rng.choice([None, 0.0, -0.0, 1.5, rng.random(), round(rng.random(), 1)])
    data = [(*group(), i, number(), number()) for i in range(n)] + [("p3", "none", 10_000, None, None), ("p3", "none", 10_001, None, 2.0)]
    return data, "period string, product string, id int, a double, b double"


def _brute_rank(data, at):
    out = {}
    for r in data:
        peers_ = [x[at] for x in data if x[:2] == r[:2] and x[at] is not None]
        v = r[at]
        out[r[2]] = (None if v is None else (sum(p < v for p in peers_) + 1 + (sum(p == v for p in peers_) - 1) / 2) / len(peers_), len(peers_))
    return out


@pytest.mark.parametrize("hot", [10**9, 100, 0])
def test_ranks_do_not_depend_on_how_groups_are_dealt(spark, hot):
    data, schema = _rows()
    df = spark.createDataFrame(data, schema)
    got = peers.with_peers(df, ["period", "product"], ["a", "b"], ["b"], hot=hot, parts=6)
    a, b = _brute_rank(data, 3), _brute_rank(data, 4)
    assert got.count() == len(data)
    for r in got.collect():
        assert (r.a_peer_percentile, r.b_peer_percentile, r.b_peer_count) == (pytest.approx(a[r.id][0], abs=1e-15) if a[r.id][0] else a[r.id][0], pytest.approx(b[r.id][0], abs=1e-15) if b[r.id][0] else b[r.id][0], b[r.id][1])


@pytest.mark.parametrize("shares", [None, 0])
def test_ranks_of_hot_groups_without_counts(spark, monkeypatch, shares):
    """Ranks alone are asked for: by broadcast, and by a join of rows and values."""
    if shares is not None:
        monkeypatch.setattr(peers, "SHARES", shares)
    data, schema = _rows(3)
    got = peers.with_peers(spark.createDataFrame(data, schema), ["period", "product"], ["a", "b"], hot=100, parts=6)
    assert got.columns == ["period", "product", "id", "a", "b", "a_peer_percentile", "b_peer_percentile"]
    a, b = _brute_rank(data, 3), _brute_rank(data, 4)
    assert {r.id: (r.a_peer_percentile, r.b_peer_percentile) for r in got.collect()} == {i: (pytest.approx(a[i][0], abs=1e-15), pytest.approx(b[i][0], abs=1e-15)) for i in a}


def test_hot_group_is_spread(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("g"), F.rand(5).alias("v"))
    counted = peers._values(df, ["g"], ["v"]).groupBy("g", "feature", "value").count()
    dealt = scan.ranged(counted, ["g", "feature"], ["value"], parts=12)
    assert dealt.filter("g = -1").select(scan.RANGE).distinct().count() >= 3  # a range is what a task scans


@pytest.mark.parametrize("hot", [10**9, 100, 0])
def test_quantiles_equal_percentile_and_brute_force(spark, hot):
    data, schema = _rows(2)
    df = spark.createDataFrame(data, schema)
    got = peers.quantiles(df, ["period", "product"], ["a", "b"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, hot=hot, parts=5)
    q = lambda f: F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    want = {(r.period, r["product"]): r for r in df.groupBy("period", "product").agg(F.count("a").alias("na"), q("a").alias("a"), F.count("b").alias("nb"), q("b").alias("b")).collect()}
    assert got.count() == len(want)
    for r in got.collect():
        w = want[(r.period, r["product"])]
        assert (r.a_count, r.b_count) == (w.na, w.nb)
        assert [r.a_q1, r.a_median, r.a_q3] == (pytest.approx(w.a, abs=1e-15) if w.a else [None] * 3)
        values = [x[4] for x in data if x[:2] == (r.period, r["product"]) and x[4] is not None]
        assert r.b_median == (pytest.approx(statistics.median(values)) if values else None)


def test_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert peers.with_peers(df, ["g"], ["v"], ["v"]).collect() == []
    assert peers.quantiles(df, ["g"], ["v"], {"median": 0.5}).collect() == []
