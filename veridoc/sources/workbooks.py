"""Workbooks (.xlsx) as a Spark data source, read and written: spark.read.format("workbook"), df.write.format("workbook").

Reading takes a workbook per task, looks at its first bytes, and streams one sheet's XML, so a task keeps only shared
texts and one batch of rows. Columns are found by header, in any order and writing. What is wrong with a file or a row
is a row of its own with a problem, or an error, as mode says.

Writing makes a workbook per task below a temporary folder. Only the commit moves them to their place; an abort deletes
the folder, so a failed write leaves nothing. Whoever wants one workbook writes one partition.

Files are opened through Arrow's file systems: local and mounted paths, HDFS and object stores by URI.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: The namespaces of the format, the first bytes of a zip, the day before serial 1 minus the format's leap
#: day that never was, the rows of a sheet, and the numbers of built-in formats that show dates or times.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT = "http://schemas.openxmlformats.org/package/2006/content-types"
MAGIC = b"PK\x03\x04"
EPOCH = datetime(1899, 12, 30)
SHEET_ROWS = 1_048_576
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

BATCH = 2000
FIXED = ["file", "row", "problem"]


def header_key(text: str) -> str:
    """What stays of a header when case, spaces and marks are left out."""
    return "".join(ch for ch in text.lower() if ch.isalnum() and ch.isascii())


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


# ---- reading -----------------------------------------------------------------------------------------------------


def column_number(reference: str) -> int:
    """From 0, of a cell's reference such as AB12."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _unescaped(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _text(node: ElementTree.Element) -> str:
    """Plain and rich text of a shared or inline string, without readings above the line."""
    tags = (f"{{{MAIN}}}t",)
    parts = [x.text or "" for x in node.iter() if x.tag in tags]
    skipped = sum(([x.text or "" for x in p.iter() if x.tag in tags] for p in node.iter(f"{{{MAIN}}}rPh")), [])
    return _unescaped("".join(parts[: len(parts) - len(skipped)] if skipped else parts))


def serial_text(value: float) -> str:
    """The day, or day and time, that a serial number of the 1900 system shows."""
    at = EPOCH + timedelta(milliseconds=round(value * 86_400_000))
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


class Workbook:
    """One open workbook: its sheets in order, shared texts, and which styles show dates."""

    def __init__(self, file):  # noqa: ANN001
        self.zip = zipfile.ZipFile(file)
        names = set(self.zip.namelist())
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels")):
                target = r.get("Target", "")
                targets[r.get("Id")] = target[1:] if target.startswith("/") else f"xl/{target}"
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = [(s.get("name"), targets[s.get(f"{{{LINKS}}}id")]) for s in book.iter(f"{{{MAIN}}}sheet")]
        self.texts: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with self.zip.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{{{MAIN}}}si":
                        self.texts.append(_text(node))
                        node.clear()
        self.dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")) for x in styles.iter(f"{{{MAIN}}}numFmt")}
            shows = DATE_FORMATS | {k for k, v in own.items() if re.search("[ymdhs]", v, re.IGNORECASE)}
            cells = styles.find(f"{{{MAIN}}}cellXfs")
            self.dates = {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in shows}

    def value(self, cell: ElementTree.Element) -> str | None:
        """A cell as text: shared, inline and rich text, results of formulas, truth values, dates by their style, numbers; errors are nothing."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            inline = cell.find(f"{{{MAIN}}}is")
            return None if inline is None else _text(inline)
        raw = cell.findtext(f"{{{MAIN}}}v")
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(raw)]
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind in ("str", "d"):
            return _unescaped(raw)
        number = float(raw)
        if int(cell.get("s", 0)) in self.dates and 1 <= number <= 2958466:
            return serial_text(number)
        return str(int(raw)) if re.fullmatch("-?[0-9]+", raw) else repr(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, target: str) -> Iterator[tuple[int, dict[int, str]]]:
        """Row number from 1, and texts by column, of each row that has any; XML is dropped as it is read."""
        last = 0
        with self.zip.open(target) as f:
            data = None
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    data = node if node.tag == f"{{{MAIN}}}sheetData" else data
                elif node.tag == f"{{{MAIN}}}row":
                    last = int(node.get("r", last + 1))
                    cells, at = {}, -1
                    for c in node.iter(f"{{{MAIN}}}c"):
                        at = column_number(c.get("r")) if c.get("r") else at + 1
                        text = self.value(c)
                        if text is not None and text.strip():
                            cells[at] = text
                    if cells:
                        yield last, cells
                    # rows hang on their parent, which would keep them all
                    data.clear()


@dataclass
class OneFile(InputPartition):
    path: str


class BadWorkbook(ValueError):
    """A file that is no workbook, or whose sheet lacks a header or rows."""


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.headers = json.loads(options.get("headers", "{}"))
        self.most = int(options.get("maxrows", SHEET_ROWS))
        self.sheet = options.get("sheet", "1")
        self.strict = options.get("mode", "FAILFAST").upper() == "FAILFAST"
        self.key = options.get("key")
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in files_of(self.path)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        kinds = [pa.int32() if n == "row" else pa.string() for n in self.names]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], self.names)
            rows.clear()
            return batch

        try:
            for row in self.found(partition.path):
                rows.append([row.get(n) for n in self.names])
                if len(rows) >= BATCH:
                    yield out()
        except BadWorkbook as e:
            if self.strict:
                raise
            rows.append([{"file": partition.path, "row": 0, "problem": str(e)}.get(n) for n in self.names])
        if rows:
            yield out()

    def found(self, path: str) -> Iterator[dict]:
        store, at = opened(path)
        with store.open_input_file(at) as f:
            if f.read(4) != MAGIC:
                raise BadWorkbook("the file is not a workbook")
            f.seek(0)
            try:
                book = Workbook(f)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, pa.ArrowException) as e:
                raise BadWorkbook("the file can't be read as a workbook") from e
            chosen = book.sheets if self.sheet == "all" else [s for i, s in enumerate(book.sheets, 1) if self.sheet in (str(i), s[0])][:1]
            many = 0
            for _, target in chosen:
                columns: dict[str, int] | None = None
                for number, cells in book.rows(target):
                    if columns is None:
                        columns = self.columns(cells)
                        continue
                    if number > self.most + 1:
                        yield {"file": path, "row": 0, "problem": f"the sheet has more than {self.most} rows; only the first {self.most} were read"}
                        break
                    values = {n: cells.get(i) for n, i in columns.items()}
                    if any(v is not None for v in values.values()):
                        many += 1
                        problem = None if self.key is None or (values.get(self.key) or "").strip() else f"{self.headers.get(self.key, self.key)} is empty"
                        yield {"file": path, "row": number, "problem": problem, **values}
            if not many:
                raise BadWorkbook("the sheet has no rows")

    def columns(self, cells: dict[int, str]) -> dict[str, int]:
        """Column numbers by name; the first of equal headers counts."""
        have: dict[str, int] = {}
        for i in sorted(cells):
            have.setdefault(header_key(cells[i]), i)
        names = [n for n in self.names if n not in FIXED]
        missing = [self.headers.get(n, n) for n in names if header_key(self.headers.get(n, n)) not in have]
        if missing:
            raise BadWorkbook(f"the sheet has no column {', '.join(missing)}")
        return {n: have[header_key(self.headers.get(n, n))] for n in names}


def files_of(path: str) -> list[str]:
    """The workbooks in a folder and below it, without what a write hasn't committed; or the file itself."""
    store, at = opened(path)
    info = store.get_file_info(at)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type == fs.FileType.File:
        return [path]
    found = [i.path for i in store.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
    base = at.rstrip("/") + "/"
    return sorted(prefix + p for p in found if p.endswith(".xlsx") and not any(x.startswith(("_", ".")) for x in p.removeprefix(base).split("/")))


# ---- writing -----------------------------------------------------------------------------------------------------


def cell_reference(column: int, row: int) -> str:
    letters, n = "", column + 1
    while n:
        n, r = divmod(n - 1, 26)
        letters = chr(65 + r) + letters
    return f"{letters}{row}"


def _marked(text: str) -> str:
    """Text for XML: signs that XML lacks as the format's escapes, and what looks like an escape escaped itself."""
    text = re.sub("_x(?=[0-9A-Fa-f]{4}_)", "_x005F_x", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text))


def cell_xml(value: object, column: int, row: int) -> str:
    """A cell by the value's kind; null is no cell. Whole numbers beyond 15 digits are text, or the format would round them."""
    at = cell_reference(column, row)
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (datetime, date)):
        when = value.astimezone(UTC).replace(tzinfo=None) if isinstance(value, datetime) and value.tzinfo else value
        when = when if isinstance(when, datetime) else datetime(when.year, when.month, when.day)
        if when >= EPOCH + timedelta(days=61):
            serial = (when - EPOCH) / timedelta(days=1)
            return f'<c r="{at}" s="{1 if serial == int(serial) else 2}"><v>{int(serial) if serial == int(serial) else repr(serial)}</v></c>'
        value = when.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    if isinstance(value, int) and abs(value) < 10**15 or isinstance(value, float) and value - value == 0 or isinstance(value, Decimal) and len(value.as_tuple().digits) <= 15:
        return f'<c r="{at}"><v>{value!r}</v></c>' if isinstance(value, float) else f'<c r="{at}"><v>{value}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_marked(str(value))}</t></is></c>'


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
STYLES = f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'


def write_workbook(file, rows: Iterator, headers: list[str], title: str) -> int:  # noqa: ANN001
    """Rows as a workbook, streamed into its zip; a full sheet is followed by another. The number of rows."""
    many, sheets, rest = 0, 0, iter(rows)
    row = next(rest, None)
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        while row is not None or not sheets:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                put = lambda text: f.write(text.encode())  # noqa: B023, E731
                put(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData><row r="1">{"".join(cell_xml(h, i, 1) for i, h in enumerate(headers))}</row>')
                n = 1
                while row is not None and n < SHEET_ROWS:
                    n += 1
                    put(f'<row r="{n}">{"".join(cell_xml(v, i, n) for i, v in enumerate(row))}</row>')
                    row = next(rest, None)
                many += n - 1
                put("</sheetData></worksheet>")
        parts = "".join(f'<sheet name="{_marked(title[:25])}{"" if i == 1 else f" {i}"}" sheetId="{i}" r:id="r{i}"/>' for i in range(1, sheets + 1))
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{parts}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, sheets + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}">{links}<Relationship Id="s" Type="{LINKS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}"><Relationship Id="r" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, sheets + 1))
        kinds += '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{CONTENT}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
    return many


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.overwrite = [f.name for f in schema.fields], overwrite
        self.path, self.title = options["path"].rstrip("/"), options.get("title", "Sheet")
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        # an attempt that is done again has a name of its own, and only the one that is committed is moved
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.xlsx"
        store, at = opened(self.job)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{name}") as f:
            n = write_workbook(f, iterator, self.names, self.title)
        return Written(name, n)

    def commit(self, messages: list[Written]) -> None:
        store, at = opened(self.path)
        _, job = opened(self.job)
        store.create_dir(at, recursive=True)
        old = [i.path for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File] if self.overwrite else []
        empty = all(m.rows == 0 for m in messages if m is not None)
        for k, m in enumerate(m for m in messages if m is not None):
            # tasks without rows leave no file, but a write without any rows leaves one with headers
            if m.rows or empty and k == 0:
                store.move(f"{job}/{m.name}", f"{at}/{re.sub(r'-[0-9]+.xlsx$', '', m.name)}-{self.job[-8:]}.xlsx")
        for p in old:
            store.delete_file(p)
        self.clean()

    def abort(self, messages: list[Written | None]) -> None:
        self.clean()

    def clean(self) -> None:
        store, job = opened(self.job)
        if store.get_file_info(job).type == fs.FileType.Directory:
            store.delete_dir(job)


class WorkbookSource(DataSource):
    """Options: path; headers (JSON, column to header, where they differ), sheet (number from 1, name, or all), maxRows,
    key (a column that each row must have), mode (FAILFAST, or PERMISSIVE: what is wrong becomes a row); title for writing.

    Columns file, row and problem, where the schema has them, are the reader's; all others are texts. Without a schema
    the headers of the first workbook are the columns.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        fixed = [StructField("file", StringType()), StructField("row", IntegerType()), StructField("problem", StringType())]
        first = files_of(self.options["path"])[0]
        store, at = opened(first)
        with store.open_input_file(at) as f:
            book = Workbook(f)
            _, cells = next(book.rows(book.sheets[0][1]))
        return StructType(fixed + [StructField(cells[i], StringType()) for i in sorted(cells)])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def read_workbooks(spark: SparkSession, path: str, headers: dict[str, str], key: str | None = None, most: int = SHEET_ROWS, permissive: bool = True, sheet: str = "1") -> DataFrame:
    """Workbooks by headers (column to header): file, row, problem, and the columns as text with white space evened; sheet: number from 1, name, or all."""
    from .sheets import cell_text

    register(spark)
    schema = ", ".join(["file string", "row int", "problem string", *(f"`{c}` string" for c in headers)])
    read = spark.read.format("workbook").schema(schema).option("headers", json.dumps(headers)).option("maxRows", most).option("sheet", sheet).option("mode", "PERMISSIVE" if permissive else "FAILFAST")
    rows = (read if key is None else read.option("key", key)).load(path)
    return rows.select(*FIXED, *[cell_text(rows[c]).alias(c) for c in headers])


def write_workbooks(df: DataFrame, path: str, title: str = "Sheet") -> None:
    """A workbook for each partition of df, in place of what the folder has."""
    register(df.sparkSession)
    df.write.format("workbook").mode("overwrite").option("title", title).save(path)
