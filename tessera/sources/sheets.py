"""Spreadsheet files: one sheet of texts, written row by row, and the first sheet of many files, read file by file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import cell_text
from tessera.sources.scratch import FileOut
from tessera.sources.tables import sheet_rows

#: Name spaces of the format, the rows and columns that it allows.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _parts(sheet: str) -> dict[str, str]:
    kinds = {"/xl/workbook.xml": "sheet.main", "/xl/worksheets/sheet1.xml": "worksheet"}
    overrides = "".join(f'<Override PartName="{part}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"/>' for part, kind in kinds.items())
    relation = lambda kind, target: f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/{kind}" Target="{target}"/></Relationships>'
    return {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>',
        "_rels/.rels": relation("officeDocument", "xl/workbook.xml"),
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relation("worksheet", "worksheets/sheet1.xml"),
    }


def write_xlsx(rows: DataFrame, path: str, sheet: str = "sheet1", cells: str = "cells", number: str = "number") -> None:
    """One file with one sheet: arrays of cell texts under their 1-based row numbers.

    Tasks make the rows' XML; the driver streams it into the file partition by partition, as the format is one archive.
    """
    if (rows.agg(F.max(number)).first()[0] or 0) > MOST_ROWS:
        raise ValueError(f"a sheet has at most {MOST_ROWS} rows")
    shown = re.sub(r'[<>&"]', "", sheet)
    out = FileOut(rows.sparkSession, path)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in _parts(shown).items():
            archive.writestr(name, part)
        with archive.open("xl/worksheets/sheet1.xml", "w") as body:
            body.write(f'{_HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for row in sheet_rows(rows, cells, number).orderBy(number).select("xml").toLocalIterator():
                body.write(row.xml.encode())
            body.write(b"</sheetData></worksheet>")
    out.close()


def first_sheet(data: bytes) -> list[tuple[int, list[str]]]:
    """(row number, cells) of the rows of a file's first sheet; cells that aren't there are empty."""
    tag = lambda name, space=MAIN: f"{{{space}}}{name}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in item.iter(tag("t"))) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(tag("si"))]
        wanted = ElementTree.fromstring(archive.read("xl/workbook.xml")).find(f"{tag('sheets')}/{tag('sheet')}").get(tag("id", OFFICE))
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        if wanted not in targets:
            raise ValueError("the workbook doesn't say where its first sheet is")
        target = targets[wanted].lstrip("/")
        body = ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
    found = []
    for row in body.iter(tag("row")):
        cells: dict[int, str] = {}
        for cell in row.findall(tag("c")):
            at = re.match(r"([A-Z]+)\d+", cell.get("r", ""))
            if not at:
                continue
            column = 0
            for letter in at[1]:
                column = column * 26 + ord(letter) - 64
            value = cell.findtext(tag("v")) or ""
            if cell.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(tag("t")))
            elif cell.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                value = shared[int(value)]
            if column <= MOST_COLUMNS:
                cells[column - 1] = value
        found.append((int(row.get("r", "0")), [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]))
    return found


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, number, cells (cleaned) of the first sheet of each file that the path or pattern names."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = first_sheet(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array([n for n, _ in own], pa.int64()), pa.array([c for _, c in own], pa.list_(pa.string()))], names=["path", "number", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "path string, number long, cells array<string>").withColumn("cells", F.transform("cells", lambda c: cell_text(c)))


def header_differences(rows: DataFrame, expected: DataFrame, depth: int = 2) -> DataFrame:
    """number, column, actual, expected of the header cells that differ between two tables of number and cells."""
    flat = lambda t, name: t.filter(F.col("number") <= depth).select("number", F.posexplode("cells").alias("column", name)).withColumn(name, cell_text(F.col(name))).filter(F.col(name) != "")
    both = flat(rows, "actual").join(flat(expected, "expected"), ["number", "column"], "full_outer").na.fill("", ["actual", "expected"])
    return both.filter("actual <> expected")
