"""Worksheet cells of .xlsx workbooks as a Spark data source.

    cells(spark, "/folder")                                      # or a file, on any path that Spark can read
    cells(spark, "/folder").filter("sheet = 'Opened'")           # opens no other sheet

One partition per sheet. A sheet is read as a stream, by standard-library zip and an XML parser, and leaves in Arrow batches of at
most BATCH rows: a task holds one batch, and the workbook's shared strings as one Arrow array. It is read twice, first to see
that it can be read to its end, so that a sheet gives all its cells or one row with its error; `whole` drops what is left of a
workbook that has such a row. One bad file never fails the rest.

Where sessions allow filters to be pushed to Python sources (`spark.sql.python.filterPushdown.enabled`; `veldspar.session` does),
equalities on workbook and sheet leave out the other partitions. `columns` names the columns that are made. Paths that pyarrow has
no file system for are read by Spark's own `binaryFile`: a task then holds one workbook's bytes, and all its sheets are read.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse, parse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition

FIELDS = {"workbook": "string", "sheet": "string", "row": "int", "col": "int", "kind": "string", "value": "string", "number_format": "string", "formula": "boolean", "error": "string"}
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PERIOD = r"(20[0-9]{2})[-_ ]?h([12])"
#: Codes of the built-in number formats.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: Cells of one Arrow batch.
BATCH = 4096


def column_number(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def _texts(z: zipfile.ZipFile) -> pa.Array:
    """Shared strings as one array: their bytes and four for each."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return pa.array([], pa.string())
    pieces, held, table = [], [], None
    with z.open("xl/sharedStrings.xml") as f:
        for event, el in iterparse(f, events=("start", "end")):
            if event == "start":
                table = el if table is None else table
            elif el.tag == f"{_M}si":
                held.append("".join(t.text or "" for t in el.iter(f"{_M}t")))
                table.clear()
                if len(held) == BATCH:
                    pieces.append(pa.array(held, pa.string()))
                    held = []
    return pa.concat_arrays([*pieces, pa.array(held, pa.string())])


def _formats(z: zipfile.ZipFile) -> list[str]:
    """Number format of each cell style, by its code."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = parse(z.open("xl/styles.xml")).getroot()
    xfs, codes = root.find(f"{_M}cellXfs"), BUILT_IN | {int(x.get("numFmtId")): x.get("formatCode") for x in root.iter(f"{_M}numFmt")}
    return [codes.get(int(x.get("numFmtId", 0)), "General") for x in xfs] if xfs is not None else []


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the worksheets, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
    found = [(s.get("name"), targets[s.get(f"{_R}id")]) for s in parse(z.open("xl/workbook.xml")).getroot().iter(f"{_M}sheet")]
    return [(name, t if t.startswith("xl/") else f"xl/{t}") for name, t in found]


def _cell(c, shared: pa.Array, formats: list[str]) -> tuple | None:
    """(row, col, kind, value, number_format, formula) of a cell element with a value or a formula."""
    kind, v, formula = c.get("t", "n"), c.find(f"{_M}v"), c.find(f"{_M}f") is not None
    text = "".join(t.text or "" for t in c.iter(f"{_M}t")) if kind == "inlineStr" else v.text if v is not None else None
    if text is None and not formula:
        return None
    text = shared[int(text)].as_py() if kind == "s" and text is not None else text
    label = {"n": "numeric", "b": "boolean", "e": "error"}.get(kind, "text")
    style = int(c.get("s", 0))
    return int(re.search("[0-9]+$", c.get("r"))[0]), column_number(c.get("r")), label, text, formats[style] if style < len(formats) else "General", formula


def sheet_cells(z: zipfile.ZipFile, member: str, shared: pa.Array, formats: list[str]) -> Iterator[tuple]:
    """Cells in row order; then each merged range, as one of kind `merged` without row and column."""
    with z.open(member) as f:
        rows = None
        for event, el in iterparse(f, events=("start", "end")):
            if event == "start":
                rows = el if el.tag == f"{_M}sheetData" else rows
            elif el.tag == f"{_M}row":
                yield from (x for x in (_cell(c, shared, formats) for c in el.iter(f"{_M}c")) if x)
                if rows is not None:
                    rows.clear()  # rows that are done are let go
            elif el.tag == f"{_M}mergeCell":
                yield None, None, "merged", el.get("ref"), None, False


def _batches(book: str, sheet: str | None, found: Iterator[tuple], columns: list[str], error: str | None = None) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = dict(zip(("row", "col", "kind", "value", "number_format", "formula"), zip(*held))) | {"workbook": [book] * len(held), "sheet": [sheet] * len(held), "error": [error] * len(held)}
        return pa.RecordBatch.from_arrays([pa.array(made[c], _ARROW[FIELDS[c]]) for c in columns], columns)

    for x in found:
        held.append(x)
        if len(held) == BATCH:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def read_sheets(book: str, file, sheets: list[tuple[str, str]] | None, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the named sheets of an open workbook, or of all; a sheet that can't be read to its end gives its error instead."""
    failed = lambda sheet, e: _batches(book, sheet, iter([(None, None, None, None, None, None)]), columns, _told(e))
    try:
        z = zipfile.ZipFile(file)
        known, shared, formats = sheets_of(z), _texts(z), _formats(z)
    except Exception as e:  # noqa: BLE001  the workbook is reported as a row
        yield from failed(None, e)
        return
    for name, member in known if sheets is None else sheets:
        try:
            for _ in sheet_cells(z, member, shared, formats):
                pass
        except Exception as e:  # noqa: BLE001
            yield from failed(name, e)
            continue
        yield from _batches(book, name, sheet_cells(z, member, shared, formats), columns)


class Sheet(InputPartition):
    """A sheet of a workbook; without a name, a workbook that couldn't be opened, which the task will say."""

    def __init__(self, path: str, sheet: tuple[str, str] | None):
        self.path, self.sheet = path, sheet


def _workbooks(path: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    fs, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    if fs.get_file_info(root).type == pyarrow.fs.FileType.File:
        return fs, [root]
    found = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.path.lower().endswith((".xlsx", ".xlsm")))
    if not found:
        raise FileNotFoundError(f"no workbooks in {path}")
    return fs, found


class SheetReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.wanted = path, columns, {}

    def partitions(self) -> list[Sheet]:
        fs, found = _workbooks(self.path)
        out: list[Sheet] = []
        for p in found:
            if not self._takes("workbook", os.path.basename(p)):
                continue
            try:
                with fs.open_input_file(p) as f:
                    out += [Sheet(p, s) for s in sheets_of(zipfile.ZipFile(f)) if self._takes("sheet", s[0])]
            except Exception:  # noqa: BLE001  the task that reads it tells the error
                out.append(Sheet(p, None))
        return out

    def _takes(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else os.path.abspath(self.path))
        with fs.open_input_file(partition.path) as f:
            yield from read_sheets(os.path.basename(partition.path), f, partition.sheet and [partition.sheet], self.columns)


class FilteringReader(SheetReader):
    """Leaves out partitions that equalities on workbook and sheet exclude; Spark still applies every filter."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute in (("workbook",), ("sheet",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            yield f


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c] or list(FIELDS)

    def schema(self) -> str:
        return ", ".join(f"{c} {FIELDS[c]}" for c in self._columns())

    def reader(self, schema) -> SheetReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else SheetReader)(self.options["path"], self._columns())


def _by_content(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Workbooks on a path that only Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xls[xm]").load(path).select("path", "content")
    if not files.select("path").head(1):
        raise FileNotFoundError(f"no workbooks in {path}")

    def read(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                yield from read_sheets(os.path.basename(name), io.BytesIO(content.as_buffer()), None, columns)

    return files.mapInArrow(read, ", ".join(f"{c} {FIELDS[c]}" for c in columns))


def cells(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The cells of all workbooks at a path, a row each; see the module's description."""
    columns = columns or list(FIELDS)
    try:
        pyarrow.fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    except (pa.ArrowInvalid, OSError):
        return _by_content(spark, path, columns)
    spark.dataSource.register(XlsxDataSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("xlsx_cells").option("columns", ",".join(columns)).option("pushdown", pushed).load(path)


def whole(df: DataFrame) -> DataFrame:
    """`df`, a cut table of cells, without the cells of workbooks of which a part could not be read; their errors stay."""
    bad = df.filter("error IS NOT NULL").select("workbook").distinct()
    return df.filter("error IS NULL").join(bad, "workbook", "left_anti").select(df.columns).unionByName(df.filter("error IS NOT NULL"))


def reporting_period(name):
    """'YYYY-Hn' from a file name; empty where there is none."""
    year, half = F.regexp_extract(F.lower(name), PERIOD, 1), F.regexp_extract(F.lower(name), PERIOD, 2)
    return F.when(year != "", F.concat(year, F.lit("-H"), half)).otherwise("")


def inventory(df: DataFrame) -> DataFrame:
    """Per sheet: value bounds, cell and formula counts, formulas without a cached value, merged ranges."""
    ok, merged = df.filter("error IS NULL"), F.col("kind") == "merged"
    return ok.groupBy("workbook", "sheet").agg(F.max("row").alias("last_row"), F.max("col").alias("last_column"), F.count(F.when(~merged, F.col("value"))).alias("cells"), F.count_if("formula").alias("formulas"), F.count_if(F.col("formula") & F.col("value").isNull()).alias("formulas_without_value"), F.count_if(merged).alias("merged_ranges"))


def wide_to_long(df: DataFrame, header: DataFrame, identifiers: list[str]) -> DataFrame:
    """Metric cells below their header row, with lineage: (workbook, sheet, source_row, source_column, raw_header, raw_value, firm_name).

    `header` (workbook, sheet, header_row). Rows without a name or named total, grand total or include are skipped.
    """
    at = ["workbook", "sheet"]
    body = df.filter("error IS NULL").join(header, at)
    heads = body.filter("row = header_row").select(*at, "col", F.trim("value").alias("raw_header"))
    below = body.filter("row > header_row").join(heads, [*at, "col"])
    named = below.filter(F.lower("raw_header") == identifiers[0].lower()).select(*at, "row", F.trim("value").alias("firm_name"))
    named = named.filter(~F.lower("firm_name").isin("total", "grand total", "include", ""))
    metric = below.filter(~F.lower("raw_header").isin([i.lower() for i in identifiers]))
    return metric.join(named, [*at, "row"]).select(*at, F.col("row").alias("source_row"), F.col("col").alias("source_column"), "raw_header", F.col("value").alias("raw_value"), "firm_name")
