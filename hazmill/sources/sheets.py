"""Spreadsheets (xlsx): read on the executors, a file a task, and written from the driver, without further libraries.

Only values of the first sheet are read, as text (numbers as they are stored). A sheet ends at 1,048,576 rows; more rows aren't written.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ROWS = 1_048_576
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        first = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[0]
        with book.open(first) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for cell in row:
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    value = cell.find(f"{_NS}v")
                    if cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif value is not None:
                        out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                yield out
                row.clear()


def read_xlsx(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table of a workbook, or of several with the same columns; the first row names them. All columns are text unless a schema says otherwise."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                names = next(sheet_rows(content.as_py()), [])
                yield pa.RecordBatch.from_arrays([pa.array([[n or f"column{i}" for i, n in enumerate(names)]], pa.list_(pa.string()))], ["names"])

    found = files.limit(1).mapInArrow(heads, "names array<string>").first()
    names = list(found.names) if found else []
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, lines = [], sheet_rows(content.as_py())
                next(lines, None)
                for line in lines:
                    held.append((line + [None] * len(names))[: len(names)])
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names)

    got = files.mapInArrow(rows, texts)
    if schema is None:
        return got
    return got.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def write_xlsx(df: DataFrame, path: str) -> None:
    """A workbook with one sheet; nested columns as JSON. Rows stream through the driver, never more than a sheet takes."""
    flat = df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string").alias(c) for c in df.columns])
    if flat.limit(MOST_ROWS).count() >= MOST_ROWS:
        raise ValueError(f"a sheet takes {MOST_ROWS - 1} rows")
    clean = lambda v: escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", v))
    line = lambda values: "<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{clean(v)}</t></is></c>' for v in values) + "</row>"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            sheet.write(line(df.columns).encode())
            for row in flat.toLocalIterator():
                sheet.write(line(row).encode())
            sheet.write(b"</sheetData></worksheet>")
