"""Table contracts: required columns, uniqueness, joins with a declared cardinality, and issue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not keep its contract."""


def require_columns(df: DataFrame, columns) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")
    return df


def available(df: DataFrame, columns) -> DataFrame:
    """Projection on those of `columns` that exist."""
    return df.select([c for c in columns if c in df.columns])


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Eager check that `keys` identify rows."""
    if dup := df.groupBy(*keys).count().filter("count > 1").limit(1).collect():
        raise ContractError(f"{keys} not unique, e.g. {dup[0].asDict()}")
    return df


def _unique(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Lazy check in the plan: the filter uses the count, so the optimizer can't prune it. It shares the join's exchange."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("__n", n).filter(F.assert_true(F.col("__n") == 1, F.lit(f"{side} side is not unique by {keys}")).isNull()).drop("__n")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "1:1", large: bool = False) -> DataFrame:
    """Equi-join that fails at run time if the declared cardinality (1:1, m:1, 1:m) does not hold.

    `large`: neither side is broadcast unless hinted. Spark takes a Parquet table for as large as its compressed files, and rows that are
    exploded for no more, so that it would send millions of rows through the driver.
    """
    if validate not in ("1:1", "m:1", "1:m"):
        raise ValueError(validate)
    if validate[0] == "1":
        left = _unique(left, on, "left")
    if validate[2] == "1":
        right = _unique(right, on, "right")
    return left.join(right.hint("merge") if large else right, on, how)


def issues(df: DataFrame, checks: dict[str, Column], severity: str = "error") -> DataFrame:
    """(severity, rule, count) of the rows that violate each check; one pass over `df`, no row for a check that holds."""
    one = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("count")) for name in checks]))
    return one.select(rows.alias("r")).select(F.lit(severity).alias("severity"), "r.rule", "r.count").filter("count > 0")
