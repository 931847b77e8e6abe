"""Small .xlsx files for tests."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write(path, sheets: dict[str, list[list]], formats: tuple[int, ...] = (0,), styles: dict | None = None, broken: tuple[str, ...] = (), merged: dict | None = None) -> None:
    """`sheets`: rows of values; text goes to the shared strings. `styles`: (sheet, row, col) to a place in `formats`. `broken`: sheets that end early."""
    texts: list[str] = []

    def cell(sheet, r, c, v):
        ref, style = f"{chr(64 + c)}{r}", (styles or {}).get((sheet, r, c), 0)
        if v is None:
            return ""
        if isinstance(v, str) and v.startswith("="):
            return f'<c r="{ref}" s="{style}"><f>{escape(v[1:])}</f></c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            texts.append(v)
            return f'<c r="{ref}" t="s" s="{style}"><v>{len(texts) - 1}</v></c>'
        return f'<c r="{ref}" s="{style}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(name, r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
            joined = "".join(f'<mergeCell ref="{m}"/>' for m in (merged or {}).get(name, ()))
            tail = "" if name in broken else f"</sheetData><mergeCells>{joined}</mergeCells></worksheet>"
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{body}{tail}")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {NS}><cellXfs>" + "".join(f'<xf numFmtId="{n}"/>' for n in formats) + "</cellXfs></styleSheet>")
