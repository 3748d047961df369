"""Workbooks: a Spark data source for sheets, and a writer, on the standard library alone.

``spark.read.format("xlsx").option("sheet", 0).load(path)`` reads one sheet by position; its first
row names the columns, all of them strings, and ``row_id`` numbers the rows from 0. A workbook is one
zip file and is read by one task; larger tables belong in Parquet.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: the name spaces of sheets and of links.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheet_rows(data: bytes, sheet: int) -> Iterator[list[str | None]]:
    """The cells of a sheet as text, row by row; a blank row is an empty list, so that places hold."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [s.get(f"{LINK}id") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        target = links[sheets[sheet]].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as body:
            given = 0
            for _, row in ElementTree.iterparse(body):
                if row.tag != f"{MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for i, cell in enumerate(row.iter(f"{MAIN}c")):
                    value = cell.find(f"{MAIN}v")
                    kind = cell.get("t")
                    text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) if kind == "inlineStr" else value.text if value is not None else None
                    if text is not None:
                        cells[_column(cell.get("r")) if cell.get("r") else i] = shared[int(text)] if kind == "s" else text
                number = int(row.get("r") or given + 1)
                row.clear()
                if cells:  # rows that are blank or not there at all come before the next one that is not
                    yield from ([] for _ in range(number - given - 1))
                    yield [cells.get(i) for i in range(max(cells) + 1)]
                    given = number


class _Reader(DataSourceReader):
    def __init__(self, data: bytes, sheet: int, width: int):
        self.data, self.sheet, self.width = data, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheet_rows(self.data, self.sheet)
        next(rows, None)
        for number, row in enumerate(rows):
            yield (number, *(row + [None] * self.width)[: self.width])


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _data(self) -> bytes:
        from pyspark.sql import SparkSession as Session

        session = Session.getActiveSession()
        if session is None:
            with open(self.options["path"], "rb") as file:
                return file.read()
        return bytes(session.read.format("binaryFile").load(self.options["path"]).select("content").first()[0])

    def _header(self) -> list[str]:
        head = next(sheet_rows(self._data(), int(self.options.get("sheet", 0))), [])
        return [name or f"_{i}" for i, name in enumerate(head)]

    def schema(self) -> str:
        return ", ".join(["row_id bigint", *(f"`{name.replace('`', '``')}` string" for name in self._header())])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._data(), int(self.options.get("sheet", 0)), len(self._header()))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxDataSource)


def book_bytes(sheets: dict[str, tuple[list[str], Iterator[tuple]]]) -> bytes:
    """A workbook of inline strings and numbers: name to (header, rows)."""
    kinds = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"}
    base = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        defaults = "".join(f'<Default Extension="{a}" ContentType="{b}"/>' for a, b in kinds.items())
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{base}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{defaults}<Override PartName="/xl/workbook.xml" ContentType="{base}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{link}"><sheets>{named}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="r{i}" Type="{link}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as sheet:
                sheet.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                for number, row in enumerate([tuple(header), *rows], 1):
                    cells = ""
                    for j, value in enumerate(row):
                        place = f"{_letters(j)}{number}"
                        if isinstance(value, (int, float)) and not isinstance(value, bool):
                            cells += f'<c r="{place}"><v>{value}</v></c>'
                        elif value is not None:
                            cells += f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
                    sheet.write(f'<row r="{number}">{cells}</row>'.encode())
                sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_book(tables: dict[str, DataFrame], path: str, most_rows: int = 1_048_575) -> None:
    """Write tables as the sheets of one workbook, rows streamed from the engine; a sheet's row limit is an error."""

    def rows(frame: DataFrame) -> list[tuple]:
        found = [tuple(row) for row in frame.limit(most_rows + 1).toLocalIterator()]
        if len(found) > most_rows:
            raise ValueError("the table has more rows than a sheet; write it as Parquet")
        return found

    data = book_bytes({name: (frame.columns, iter(rows(frame))) for name, frame in tables.items()})
    spark = next(iter(tables.values())).sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    stream.write(bytearray(data))
    stream.close()
