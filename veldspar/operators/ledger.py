"""Decision ledgers: what people decided, appended and never changed, with the latest decision of each key beside it.

`entries` keeps every decision with the number of the update that brought it; `current` has one row for each key. Both are partitioned by
a bucket of the key, so that an update reads the entries of the buckets it touches and rewrites these partitions of `current` alone
(dynamic partition overwrite); the others keep their files. `current` follows from `entries`: `rebuild` makes it anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.contracts import ContractError, require_columns
from veldspar.sources.files import read_csv
from veldspar.store import cut

BUCKET, UPDATE = "bucket", "update"


@dataclass(frozen=True)
class Kind:
    """Columns of a ledger, and what a decision needs; all columns are text. `decided` names the column with the decision."""

    keys: tuple[str, ...]
    columns: tuple[str, ...]
    decided: str
    allowed: tuple[str, ...] | None = None
    #: Decisions that need a reviewer and a date; None for all that aren't empty.
    signed: tuple[str, ...] | None = None
    buckets: int = 64

    @property
    def all(self) -> list[str]:
        return [*self.keys, *self.columns]


#: The ledgers of the profiling review and of metric cells under quality review.
PROFILING = Kind(("review_item_id",), ("decision", "reviewer", "reviewed_at", "reviewer_comment"), "decision", ("approved", "approved_with_conditions", "rejected", ""), ("approved", "approved_with_conditions"))
QUALITY = Kind(("reporting_period", "source_workbook", "source_sheet", "source_row", "source_column"), ("quality_flag", "quality_review_status", "reviewer", "reviewed_at", "reviewer_comment"), "quality_review_status", signed=())


def checked(decisions: DataFrame, kind: Kind) -> DataFrame:
    """Decisions with all columns, empty for null, once for each key, with known values and signed where they have to be."""
    d = require_columns(decisions, kind.all).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kind.all])
    d = cut(d, "decisions")
    told, signed = F.col(kind.decided), F.trim("reviewer") != ""
    needs = told != "" if kind.signed is None else told.isin(*kind.signed) if kind.signed else F.lit(False)
    unknown = F.count_if(~told.isin(*kind.allowed)) if kind.allowed else F.lit(0)
    bad = d.agg(unknown.alias("unknown decisions"), F.count_if(needs & ~(signed & (F.trim("reviewed_at") != ""))).alias("without reviewer or date")).first().asDict()
    bad["keys that repeat"] = d.groupBy(*kind.keys).count().filter("count > 1").count()
    if found := {k: n for k, n in bad.items() if n}:
        raise ContractError(f"decisions are not accepted: {found}")
    return d


class Ledger:
    """A ledger in a folder on any path that Spark writes."""

    def __init__(self, spark: SparkSession, path: str, kind: Kind):
        self.spark, self.kind = spark, kind
        self.entries, self.current = f"{path}/entries", f"{path}/current"

    @property
    def _schema(self) -> str:
        return ", ".join(f"{c} string" for c in self.kind.all) + f", {UPDATE} long, {BUCKET} int"

    def _read(self, path: str) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(path)

    def history(self) -> DataFrame:
        """Every decision that was ever made, with the number of its update."""
        return self._read(self.entries).drop(BUCKET)

    def latest(self) -> DataFrame:
        """The decision that holds for each key."""
        return self._read(self.current).drop(BUCKET)

    def append(self, decisions: DataFrame) -> int:
        """Take up decisions and give back the number of the update; nothing is written if one of them isn't accepted."""
        new = checked(decisions, self.kind)
        number = (self._read(self.entries).agg(F.max(UPDATE)).first()[0] or 0) + 1
        bucket = F.pmod(F.xxhash64(*self.kind.keys), F.lit(self.kind.buckets)).cast("int")
        new = cut(new.withColumns({UPDATE: F.lit(number).cast("long"), BUCKET: bucket}), "decisions")
        new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.entries)
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
        self._refresh(self._read(self.entries).filter(F.col(BUCKET).isin(touched)))
        return number

    def rebuild(self) -> None:
        """Make all of `current` from the entries."""
        self._refresh(self._read(self.entries))

    def _refresh(self, entries: DataFrame) -> None:
        last = F.max_by(F.struct(*self.kind.columns, UPDATE), F.col(UPDATE)).alias("__last")
        found = entries.groupBy(BUCKET, *self.kind.keys).agg(last).select(*self.kind.keys, "__last.*", BUCKET)
        found.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.current)

    def load(self, csv: str) -> int:
        """Take up a CSV file that people filled in."""
        return self.append(read_csv(self.spark, csv, ", ".join(f"{c} string" for c in self.kind.all), True))
