"""Workbook files (xlsx), with the standard library alone.

A workbook is one compressed file of at most MOST_ROWS rows a sheet, so it is
read by one task and written by the driver, row by row; larger tables belong in
Parquet or CSV.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the format allows on a sheet, and its name spaces.
MOST_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Columns are as wide as their longest cell and two more, up to this.
WIDEST = 40

_bad = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        n, last = divmod(n, 26)
        out, n = chr(65 + last) + out, n - 1
    return out


def _texts(element) -> str:
    """Text of a string item, without its phonetic hints."""
    return "".join(t.text or "" for part in element if not part.tag.endswith("}rPh") for t in part.iter(f"{{{MAIN}}}t"))


def _value(cell, shared: list[str]) -> str | None:
    kind, v = cell.get("t", "n"), cell.find(f"{{{MAIN}}}v")
    if kind == "inlineStr":
        return _texts(cell)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text == "1")
    if kind == "n":
        number = float(v.text)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return v.text


def cells(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet, the first unless named, as texts; an empty cell is None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(f"{{{RELATIONS}}}id")] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")}
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{{{MAIN}}}c"):
                    at = _column(re.match("[A-Z]*", cell.get("r", ""))[0]) if cell.get("r") else len(out)
                    out += [None] * (at - len(out)) + [_value(cell, shared)]
                yield out
                row.clear()


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet's rows in order, as texts under the headers of its first row."""
    file = spark.read.format("binaryFile").load(path).select("content")

    def run(batches, only_first: bool):
        for batch in batches:
            for content in batch["content"]:
                rows = cells(bytes(content), sheet)
                if only_first:
                    yield pd.DataFrame({"n": [0], "c": [next(rows, [])]})
                    continue
                next(rows, None)
                part: list[list[str | None]] = []
                for row in rows:
                    part.append(row)
                    if len(part) == 5000:
                        yield pd.DataFrame({"n": range(len(part)), "c": part})
                        part = []
                yield pd.DataFrame({"n": range(len(part)), "c": part})

    kinds = "n bigint, c array<string>"
    first = file.mapInPandas(lambda b: run(b, True), kinds).first()
    names = [x for x in (first.c if first else [])]
    rows = file.mapInPandas(lambda b: run(b, False), kinds)
    rows = rows.filter(F.exists("c", lambda x: x.isNotNull()))
    return rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names) if n])


def _sheet_xml(header: list[str], rows: Iterator[tuple]) -> bytes:
    body, widths, n = io.StringIO(), [len(h.strip()) for h in header], 0

    def line(values, number: int) -> None:
        body.write(f'<row r="{number}">')
        for i, v in enumerate(values):
            if v is None or v == "":
                continue
            at = f"{_letters(i)}{number}"
            widths[i] = max(widths[i], len(str(v)))
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                body.write(f'<c r="{at}"><v>{v!r}</v></c>')
            else:
                body.write(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_bad.sub("", str(v)))}</t></is></c>')
        body.write("</row>")

    line(header, 1)
    for n, row in enumerate(rows, 2):
        if n > MOST_ROWS:
            raise ValueError(f"a sheet holds {MOST_ROWS} rows at most; write Parquet or CSV instead")
        line(row, n)
    columns = "".join(f'<col min="{i}" max="{i}" width="{min(w + 2, WIDEST)}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><cols>{columns}</cols><sheetData>{body.getvalue()}</sheetData></worksheet>'.encode()


def write(spark: SparkSession, path: str, sheets: dict[str, DataFrame]) -> None:
    """Sheets, by name, into one file at a path that Spark can reach; what is there is replaced."""
    types = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    out, parts, relations = io.BytesIO(), "", ""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, df) in enumerate(sheets.items(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(df.columns, map(tuple, df.toLocalIterator())))
            types += f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            parts += f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>'
            relations += f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>'
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{parts}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships">{relations}</Relationships>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()

