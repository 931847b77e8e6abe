"""The library's cut tables and measured broadcasts, and bounds on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from veldspar.store import BROADCAST_BYTES, cut, discard, folder, hinted, passing, rows, size, table

__all__ = ["BROADCAST_BYTES", "cut", "discard", "folder", "hinted", "passing", "rows", "short_batches", "size", "table"]


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000, most: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of at most `rows` rows and about `most` bytes for what runs inside; the caller's settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": most}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, bound in wanted.items():
            held = before[key].lower().removesuffix("b")
            if not held.isdigit() or not 0 < int(held) <= bound:
                spark.conf.set(key, str(bound))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
