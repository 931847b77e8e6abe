"""Workbooks: sheets as partitions, pushed filters, batches, failing sheets, and the route by content."""

from __future__ import annotations

import tracemalloc
import zipfile

import pyarrow.fs
import pytest
from pyspark.sql.datasource import EqualTo, In, IsNotNull

from tests import workbooks
from veldspar.sources import xlsx


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    (at / "deep").mkdir()
    workbooks.write(at / "a 2025-H1.xlsx", {"Opened": [["Firm", "Home"], ["Acmé & Co", 5], [None, "=B2"]], "Notes": [["x", True]]}, merged={"Opened": ["A1:B1"]})
    workbooks.write(at / "deep/b 2025-H2.xlsm", {"Opened": [["Firm", "Home"], ["Beta", 7.5]], "Closed": [["y"]]}, broken=("Closed",))
    (at / "c.xlsx").write_bytes(b"no zip")
    return at


CELLS = [
    ("a 2025-H1.xlsx", "Notes", 1, 1, "text", "x"), ("a 2025-H1.xlsx", "Notes", 1, 2, "boolean", "1"), ("a 2025-H1.xlsx", "Opened", 1, 1, "text", "Firm"), ("a 2025-H1.xlsx", "Opened", 1, 2, "text", "Home"),
    ("a 2025-H1.xlsx", "Opened", 2, 1, "text", "Acmé & Co"), ("a 2025-H1.xlsx", "Opened", 2, 2, "numeric", "5"), ("a 2025-H1.xlsx", "Opened", 3, 2, "numeric", None), ("a 2025-H1.xlsx", "Opened", None, None, "merged", "A1:B1"),
]
BETA = [("b 2025-H2.xlsm", "Opened", r, c, "text" if v != "7.5" else "numeric", v) for r, c, v in ((1, 1, "Firm"), (1, 2, "Home"), (2, 1, "Beta"), (2, 2, "7.5"))]


def _plain(df):
    return sorted((tuple(r)[:6] for r in df.filter("error IS NULL").collect()), key=repr)


def _errors(df):
    return sorted((r.workbook, r.sheet or "") for r in df.filter("error IS NOT NULL").collect())


def test_cells_by_both_routes(spark, folder):
    for df in (xlsx.cells(spark, str(folder)), xlsx.cells(spark, f"file://{folder}"), xlsx._by_content(spark, str(folder), list(xlsx.FIELDS))):
        assert _plain(df) == sorted(CELLS + BETA, key=repr)
        assert _errors(df) == [("b 2025-H2.xlsm", "Closed"), ("c.xlsx", "")]
    one = xlsx.cells(spark, str(folder / "a 2025-H1.xlsx"))
    assert _plain(one) == sorted(CELLS, key=repr) and _errors(one) == []
    with pytest.raises(Exception, match="no workbooks"):
        xlsx.cells(spark, str(folder / "nowhere")).count()


def test_whole_workbooks_only(spark, folder):
    got = xlsx.whole(xlsx.cells(spark, str(folder)))
    assert _plain(got) == sorted(CELLS, key=repr) and len(_errors(got)) == 2


def test_filters_leave_out_sheets(spark, folder):
    def parts(*filters):
        reader = xlsx.FilteringReader(str(folder), ["sheet"])
        assert list(reader.pushFilters(filters)) == list(filters)
        return sorted((p.path.rsplit("/", 1)[-1], p.sheet and p.sheet[0]) for p in reader.partitions())

    assert parts() == [("a 2025-H1.xlsx", "Notes"), ("a 2025-H1.xlsx", "Opened"), ("b 2025-H2.xlsm", "Closed"), ("b 2025-H2.xlsm", "Opened"), ("c.xlsx", None)]
    assert parts(EqualTo(("sheet",), "Notes"), IsNotNull(("sheet",))) == [("a 2025-H1.xlsx", "Notes"), ("c.xlsx", None)]
    assert parts(In(("sheet",), ("Notes", "Opened")), EqualTo(("workbook",), "a 2025-H1.xlsx")) == [("a 2025-H1.xlsx", "Notes"), ("a 2025-H1.xlsx", "Opened")]
    assert parts(EqualTo(("sheet",), "Notes"), EqualTo(("sheet",), "Opened")) == [("c.xlsx", None)]
    df = xlsx.cells(spark, str(folder)).filter("sheet = 'Notes'")
    assert df.rdd.getNumPartitions() == 2 and df.count() == 2  # the sheet, and a workbook that no one can look into


def test_columns_are_pruned(spark, folder):
    df = xlsx.cells(spark, str(folder), ["sheet", "value"])
    assert df.columns == ["sheet", "value"] and df.filter("value = 'Beta'").count() == 1


def test_memory_is_a_batch(tmp_path):
    """A sheet of ten times the rows takes the same memory."""
    peaks = []
    for n in (3_000, 30_000):
        path = tmp_path / f"{n}.xlsx"
        workbooks.write(path, {"s": [[i, i + 0.5, i * 2] for i in range(n)]})
        tracemalloc.start()
        with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as f:
            rows = sum(b.num_rows for b in xlsx.read_sheets("x", f, None, list(xlsx.FIELDS)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == 3 * n
    assert peaks[1] < 1.5 * peaks[0]


def test_damaged_bytes_are_an_error(tmp_path):
    path = tmp_path / "x.xlsx"
    workbooks.write(path, {"s": [[f"text {i}", i] for i in range(500)], "t": [["fine"]]})
    data = bytearray(path.read_bytes())
    at = zipfile.ZipFile(path).getinfo("xl/worksheets/s1.xml").header_offset + 60
    data[at : at + 40] = bytes(40)
    path.write_bytes(data)
    with path.open("rb") as f:
        got = [r for b in xlsx.read_sheets("x", f, None, ["sheet", "value", "error"]) for r in b.to_pylist()]
    assert [(r["sheet"], r["error"] is None) for r in got] == [("s", False), ("t", True)]
