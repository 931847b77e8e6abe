"""CSV and file sources and sinks with explicit absence semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.contracts import ContractError
from veldspar.sources import releases


def read_csv(spark: SparkSession, path: str, schema: str, keep_empty: bool = False) -> DataFrame:
    """CSV with a declared schema; with `keep_empty` text cells are '' instead of null."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("emptyValue", "").csv(path)
    return df.na.fill("", [c for c, t in df.dtypes if t == "string"]) if keep_empty else df


def read_table(spark: SparkSession, path: str, columns: list[str] = (), fmt: str = "parquet") -> DataFrame:
    """A table that has to be there, with all of `columns`; the error names the path, and what is missing of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise ContractError(f"input is missing: {path}")
    df = spark.read.format(fmt).option("header", True).load(path)
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"{path} has no columns {missing}")
    return df


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Name, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, rows, columns) of named sources, counted in one job; for Parquet from its footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows", F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_template(df: DataFrame, path: str) -> None:
    """Create a decision ledger if there is none; one that people have filled in is never overwritten."""
    df.write.mode("ignore").option("header", True).csv(path)


def publish(tables: dict[str, DataFrame], issues: DataFrame, folder: str) -> releases.Release:
    """Write all tables, then release them, or fail if there are issues: evidence survives the failure, and so does the last release."""
    return releases.publish(issues.sparkSession, folder, tables, known_issues=issues)


def markdown(df: DataFrame, limit: int | None = None) -> str:
    """A small result as a Markdown table: all rows, or the first `limit` with a line that says how many are left out."""
    rows = df.collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    left = len(rows) - len(rows[:limit])
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows[:limit]), *([f"\n{left} more rows"] if left else [])])
