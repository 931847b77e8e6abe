"""Tables that cut lineage, named intermediate tables that queries share, and joins that broadcast only what was counted first."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a table that is broadcast, as `size` counts them.
BROADCAST_BYTES = 48 << 20
_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("made", default=None)
_versions: ContextVar[dict | None] = ContextVar("versions", default=None)
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; our own, one for each application, only on a local master where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="veldspar-")
    return _own[app]


def cut(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it again: later stages restart from the files, whatever executor is lost.

    `keep`: the table outlives the `passing` block it is made in.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None and not keep:
        made.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = True
    return out


def settled(df: DataFrame, name: str = "t") -> DataFrame:
    """`df` if it is a cut or named table, which can be read many times; else cut."""
    return df if getattr(df, "_cut", False) else cut(df, name)


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file that isn't there yet; False where it is. It is never overwritten."""
    fs, at = _at(spark, path)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
    except Exception:
        if not fs.exists(at):
            raise
        return False
    return True


def text_of(spark: SparkSession, path: str) -> str:
    """A small text file of one line."""
    return spark.read.text(path).first()[0]


def discard(made: list[tuple[SparkSession, str]]) -> None:
    for spark, path in made:
        fs, at = _at(spark, path)
        fs.delete(at, True)


@contextmanager
def passing() -> Iterator[None]:
    """Tables cut inside are deleted at the end, by this thread's block alone. What leaves the block has to be cut with `keep`."""
    made: list[tuple[SparkSession, str]] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        discard(made)


@cache
def _edition() -> str:
    """Digest of this package's source: a table that other code made is not taken for one of this code."""
    root = Path(__file__).parent
    return hashlib.sha256(b"".join(p.read_bytes() for p in sorted(root.rglob("*.py")))).hexdigest()


def _version(spark: SparkSession, sources: list[str]) -> list:
    """What tells one state of the source files from another: paths, lengths and times, listed by Spark, contents unread."""
    seen, key = _versions.get(), tuple(sorted(sources))
    if seen is None or key not in seen:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sources)
        found = list(files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())
        if seen is None:
            return found
        seen[key] = found
    return seen[key]


def named(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame], **settings) -> DataFrame:
    """The table that `build` makes of the files `sources` under `settings`; built once, then read by every query and, where the
    folder lasts, by later applications.

    The key holds the state of every source file and of this package's code, so that new input or new code makes a new table. Rows are written to a folder of their own,
    and one small pointer file, created but never overwritten, makes them current: a build that fails leaves nothing that
    readers see, and of two builds at once the first to finish counts.
    """
    # Tables that this one is built of are made of the same state of the files: it is looked at once for all of them.
    token = _versions.set({}) if _versions.get() is None else None
    try:
        return _named(spark, name, sources, build, settings)
    finally:
        if token is not None:
            _versions.reset(token)


def _named(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame], settings: dict) -> DataFrame:
    told = json.dumps([_edition(), name, sorted(sources), _version(spark, sources), settings], sort_keys=True, default=str)
    base = f"{folder(spark)}/named/{name}-{hashlib.sha256(told.encode()).hexdigest()[:24]}"
    fs, pointer = _at(spark, f"{base}.current")
    if not fs.exists(pointer):
        path = f"{base}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        if not created(spark, f"{base}.current", path):
            discard([(spark, path)])
    out = spark.read.parquet(text_of(spark, f"{base}.current"))
    out._cut = True
    return out


def size(df: DataFrame) -> int:
    """About how many bytes the rows of `df` take on the heap; `df` should be a cut table, or cheap to read twice."""
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    n, *long = df.agg(F.count(F.lit(1)), *[F.sum(F.octet_length(c)) for c in texts]).first()
    return n * (24 + 8 * len(df.columns)) + sum(x or 0 for x in long)


def rows(made: DataFrame) -> int:
    """Rows of a cut table, from its files' footers; counted once."""
    if getattr(made, "_cut_rows", None) is None:
        made._cut_rows = made.count()
    return made._cut_rows


def hinted(df: DataFrame, most: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
    """`df` with a broadcast hint if its measured size is small; else unhinted, so that the join shuffles.

    `of`: the cut table of which `df` has at most the rows, with columns of fixed width; then `df` itself isn't run for it.
    """
    taken = size(df) if of is None else rows(of) * (24 + 8 * len(df.columns))
    return F.broadcast(df) if taken <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
