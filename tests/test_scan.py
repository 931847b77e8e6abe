"""Range-partitioned scans against windows, and named tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar import store
from veldspar.plans import scan


@pytest.mark.parametrize("keys", [["k"], []])
def test_scan_equals_window(spark, keys):
    rng = random.Random(3)
    data = [(rng.choice(["a", "hot", "hot", "hot", None, "z"]), i, rng.randrange(9), rng.choice([None, None, f"v{i}"])) for i in range(600)]
    df = spark.createDataFrame(data, "k string, i long, n long, v string")
    got = scan.scan(df, keys, ["i"], sums={"total": F.col("n")}, lasts={"filled": F.col("v")}, parts=7)
    so_far = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("*", F.sum("n").over(so_far).alias("total"), F.last("v", True).over(so_far).alias("filled"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_key_lies_in_many_ranges(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") + 2).alias("k"), "id")
    dealt = scan.ranged(df, ["k"], ["id"], parts=8)
    assert dealt.filter("k = 1").select(scan.RANGE).distinct().count() >= 5
    assert scan._spanning(dealt, ["k"]).count() < 8


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "k string, i long, n long")
    assert scan.scan(df, ["k"], ["i"], sums={"total": F.col("n")}).collect() == []


def test_named_table_is_built_once_for_each_state(spark, tmp_path):
    source, built = f"{tmp_path}/in", []

    def build():
        built.append(1)
        return spark.read.parquet(source).groupBy().agg(F.sum("id").alias("s"))

    spark.range(10).write.parquet(source)
    ask = lambda **s: store.named(spark, "sums", [source], build, **s).first()["s"]
    assert [ask(), ask(), len(built)] == [45, 45, 1]
    assert ask(least=2) == 45 and len(built) == 2  # other settings
    spark.range(20).write.mode("overwrite").parquet(source)
    assert ask() == 190 and len(built) == 3  # other input


def test_named_table_of_a_failed_build_is_not_seen(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(3).write.parquet(source)
    with pytest.raises(Exception):
        store.named(spark, "fails", [source], lambda: spark.read.parquet(source).select(F.raise_error(F.lit("no")).alias("x")))
    assert store.named(spark, "fails", [source], lambda: spark.read.parquet(source)).count() == 3


def test_cut_tables_of_one_thread_stay_out_of_anothers_block(spark):
    from threading import Thread

    kept = []
    with store.passing():
        t = Thread(target=lambda: kept.append(store.cut(spark.range(5))))
        t.start()
        t.join()
        gone = store.cut(spark.range(3))
    assert kept[0].count() == 5
    with pytest.raises(Exception):
        gone.count()
