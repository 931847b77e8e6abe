"""Releases: sets of tables that become current together, written by a data source with staging, commit and abort.

    publish(spark, folder, {"fact": df, ...}, packs={"fact": (...)})   # -> Release, or an error that leaves the last one current
    read(spark, folder, "fact")                                        # the current release; version=3 for an older one

Layout: `<folder>/<table>/run=<id>/part-*.parquet` with `_manifest.json`, `<folder>/runs/<id>.json` with what came of each run,
`<folder>/releases/<number>.json`, which names the run that a release consists of.

Each task writes one file and tells its name, rows and bytes in its commit message. The driver's commit deletes files of tasks
that ran twice and writes the manifest; abort deletes the run's files. A release exists once its own small file does, which
is created, never overwritten. So a failed task, a failed table or a broken rule leaves the last release as it was. Tables of a run
that breaks a rule stay beside it as evidence, with the issues in `runs`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from veldspar.contracts import ContractError
from veldspar.operators import packs
from veldspar.store import created, discard, text_of

MANIFEST = "_manifest.json"


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int
    bytes: int


class ReleaseWriter(DataSourceArrowWriter):
    """Writes one run of one table; `path` is any URI that pyarrow has a file system for, or a mounted path."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def _at(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pyarrow.RecordBatch]) -> Part:
        fs, root = self._at()
        name, rows, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = pyarrow.parquet.ParquetWriter(fs.open_output_stream(f"{root}/{name}"), batch.schema, compression="zstd")
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Part(None, 0, 0)
        out.close()
        return Part(name, rows, fs.get_file_info(f"{root}/{name}").size)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = self._at()
        parts = [m for m in messages if m is not None and m.name]
        fs.create_dir(root, recursive=True)
        for found in fs.get_file_info(pyarrow.fs.FileSelector(root)):  # of tasks that were tried twice
            if found.base_name.startswith("part-") and found.base_name not in {p.name for p in parts}:
                fs.delete_file(found.path)
        told = {"files": [{"name": p.name, "rows": p.rows, "bytes": p.bytes} for p in parts], "rows": sum(p.rows for p in parts), "schema": self.schema.jsonValue()}
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(told).encode())

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = self._at()
        if fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(root)


class ReleaseDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "release_run"

    def writer(self, schema: StructType, overwrite: bool) -> ReleaseWriter:
        return ReleaseWriter(self.options["path"], schema)


@dataclass(frozen=True)
class Release:
    version: int
    run: str
    rows: dict[str, int]
    issues: list[dict]


def write_run(df: DataFrame, path: str) -> dict:
    """Write a table as one run and give back its manifest."""
    spark = df.sparkSession
    spark.dataSource.register(ReleaseDataSource)
    df.write.format("release_run").mode("append").option("path", path).save()
    return _manifest(path)


def _manifest(path: str) -> dict:
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of all releases, the current one last."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/releases", allow_not_found=True))
    return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))


def _told(spark: SparkSession, folder: str, version: int | None) -> dict:
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise ContractError(f"no release {'' if version is None else version} in {folder}")
    return json.loads(text_of(spark, f"{folder}/releases/{known[-1] if version is None else version:08d}.json"))


def read(spark: SparkSession, folder: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the current release, or of an older one: the files that its manifest names, and no others."""
    told = _told(spark, folder, version)
    if table not in told["rows"]:
        raise ContractError(f"release has no table {table!r}")
    path = f"{folder}/{table}/run={told['run']}"
    manifest = _manifest(path)
    schema = StructType.fromJson(manifest["schema"])
    files = [f"{path}/{f['name']}" for f in manifest["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], packs_of: dict[str, tuple] | None = None, known_issues: DataFrame | None = None) -> Release:
    """Write all tables, each once, with the counts of their rules observed on the way; then release them, or fail.

    `packs_of`: rules for each table, see `veldspar.operators.packs`. Warnings are told, errors keep the run from being released.
    `known_issues` (severity, rule, count): issues that were found before.
    """
    run, manifests, found = uuid.uuid4().hex, {}, []
    if reserved := {"runs", "releases"} & set(tables):
        raise ContractError(f"reserved names: {sorted(reserved)}")
    say = lambda status, **more: created(spark, f"{folder}/runs/{run}.json", json.dumps({"run": run, "status": status, "rows": {t: m["rows"] for t, m in manifests.items()}, "issues": found} | more, default=str))
    try:
        if known_issues is not None:
            found += [r.asDict() for r in known_issues.select("severity", "rule", "count").collect()]  # a row for each rule
        for name, df in tables.items():
            seen = packs.observed(df, (packs_of or {}).get(name, ()), tables)
            manifests[name] = write_run(seen.rows, f"{folder}/{name}/run={run}")
            found += [{"table": name} | issue for issue in seen.issues(manifests[name]["rows"])]
        found += packs.across({n: m["rows"] for n, m in manifests.items()}, packs_of or {})
    except Exception as e:
        discard([(spark, f"{folder}/{name}/run={run}") for name in tables])
        manifests = {}
        say("failed", error=f"{type(e).__name__}: {str(e)[:2000]}")
        raise
    if errors := [i for i in found if i["severity"] == "error"]:
        say("rejected")
        raise ContractError(json.dumps(errors))
    say("released")
    rows = {t: m["rows"] for t, m in manifests.items()}
    while True:
        version = max(versions(spark, folder), default=0) + 1
        if created(spark, f"{folder}/releases/{version:08d}.json", json.dumps({"run": run, "rows": rows})):
            return Release(version, run, rows, found)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, status, issues, error) of every run, released or not."""
    schema = "run string, status string, rows map<string,long>, issues array<struct<severity:string,rule:string,count:long,table:string>>, error string"
    return spark.read.schema(schema).json(f"{folder}/runs").select("run", "status", F.col("issues"), "error")
