"""Spreadsheet workbooks (Office Open XML) as a data source and a sink.

Reading plans a partition for each sheet of each workbook and streams its rows out of the zipped XML; a sheet's rows
keep their order. Writing lets each task leave its rows as a fragment of sheet XML in a folder of the job; the commit
strings the fragments together in the order of the partitions, as one sheet of one workbook, which takes its place
only when it is whole. What a job that fails has written is taken away and the workbook stays as it was.

A sheet holds 1,048,576 rows by its format, so what one commit strings together is bounded; it is copied in pieces."""

from __future__ import annotations

import datetime as dt
import json
import posixpath
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import capped_cell

# The planner's and the executors' Python processes get the data source's code with its class.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 4096
#: Fixed values of the format: rows of a sheet, characters of a cell, of a sheet's name, and digits that a number keeps.
ROWS, CELL, NAME, DIGITS = 1_048_576, 32_767, 31, 15
#: Fixed values of the format: built-in number formats that are dates or times.
DATE_FORMATS = (*range(14, 23), *range(45, 48))
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
WRITER = "scoreloom"
_HIDDEN = re.compile(r"_x([0-9A-Fa-f]{4})_")
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f￾￿]")


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- reading


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _shown(text: str) -> str:
    """Characters that XML can't hold stand as _xHHHH_."""
    return _HIDDEN.sub(lambda m: chr(int(m[1], 16)), text)


def _texts(element) -> str:
    """The text of a string item: its own, or that of its runs, without phonetic hints."""
    out = []
    for child in element:
        name = _local(child.tag)
        if name == "t":
            out.append(child.text or "")
        elif name == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return _shown("".join(out))


def _items(file, wanted: str) -> Iterator:
    """Elements of one name, each emptied when it has been looked at."""
    root = None
    for event, element in iterparse(file, ("start", "end")):
        if root is None:
            root = element
        if event == "end" and _local(element.tag) == wanted:
            yield element
            element.clear()
            if len(root) and root[-1] is element:
                root.clear()


class _Book:
    """A workbook's sheets, strings and date styles."""

    def __init__(self, uri: str):
        self.fs, path = _opened(uri)
        self.zip = zipfile.ZipFile(self.fs.open_input_file(path))
        links = {}
        with self.zip.open("xl/_rels/workbook.xml.rels") as file:
            links = {e.get("Id"): posixpath.normpath(posixpath.join("xl", e.get("Target"))) if not e.get("Target").startswith("/") else e.get("Target")[1:] for e in _items(file, "Relationship")}
        #: (name, member) of the sheets, in their order.
        self.sheets: list[tuple[str, str]] = []
        self.epoch = dt.datetime(1899, 12, 30)
        with self.zip.open("xl/workbook.xml") as file:
            for _, e in iterparse(file):
                if _local(e.tag) == "sheet":
                    self.sheets.append((e.get("name"), links[e.get(f"{{{LINKS}}}id")]))
                elif _local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true"):
                    self.epoch = dt.datetime(1904, 1, 1)

    def _members(self, name: str) -> bool:
        return name in self.zip.NameToInfo

    def strings(self) -> list[str]:
        if not self._members("xl/sharedStrings.xml"):
            return []
        with self.zip.open("xl/sharedStrings.xml") as file:
            return [_texts(e) for e in _items(file, "si")]

    def date_styles(self) -> set[int]:
        if not self._members("xl/styles.xml"):
            return set()
        own, styles = {}, []
        with self.zip.open("xl/styles.xml") as file:
            for _, e in iterparse(file):
                if _local(e.tag) == "numFmt":
                    own[int(e.get("numFmtId"))] = e.get("formatCode")
                elif _local(e.tag) == "cellXfs":
                    styles = [int(x.get("numFmtId") or 0) for x in e]
        is_date = lambda code: re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())) is not None
        return {k for k, f in enumerate(styles) if f in DATE_FORMATS or (f in own and is_date(own[f]))}

    def rows(self, member: str) -> Iterator[dict[int, object]]:
        """Each row's values by the number of their column; rows left out of the file are empty."""
        strings, dates, at = self.strings(), self.date_styles(), 0
        with self.zip.open(member) as file:
            for row in _items(file, "row"):
                number = int(row.get("r") or at + 1)
                for _ in range(at + 1, number):
                    yield {}
                at, column, out = number, -1, {}
                for cell in row:
                    place = cell.get("r")
                    column = _column(place) if place else column + 1
                    value = self._value(cell, strings, dates)
                    if value is not None:
                        out[column] = value
                yield out

    def _value(self, cell, strings: list[str], dates: set[int]):
        kind, raw = cell.get("t") or "n", None
        for child in cell:
            name = _local(child.tag)
            if name == "v":
                raw = child.text
            elif name == "is":
                return _texts(child)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return strings[int(raw)]
        if kind == "b":
            return raw in ("1", "true")
        if kind in ("str", "d"):
            return _shown(raw)
        number = float(raw)
        if int(cell.get("s") or 0) in dates:
            return self.epoch + dt.timedelta(microseconds=round(number * 86_400_000) * 1000)
        return int(raw) if re.fullmatch(r"-?\d+", raw) else int(number) if number.is_integer() and abs(number) < 10**DIGITS else number


def _column(place: str) -> int:
    """Number from 0 of the column in a cell's place, such as 27 of AB12."""
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _said(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat(" ", "seconds" if not value.microsecond else "milliseconds")
    return str(value)


def _as(value, kind: T.DataType):
    """A cell's value as the column's type; null where it can't be."""
    try:
        if value is None or isinstance(kind, T.StringType):
            return None if value is None else _said(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}.get(str(value).strip().lower())
        if isinstance(kind, T.IntegralType):
            whole = Decimal(str(value))
            return int(whole) if whole == int(whole) else None
        if isinstance(kind, T.DecimalType):
            return Decimal(str(value))
        if isinstance(kind, T.FractionalType):
            return float(value)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            when = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).strip())
            return when.date() if isinstance(kind, T.DateType) else when if isinstance(kind, T.TimestampNTZType) else when.replace(tzinfo=dt.timezone.utc)
    except (ValueError, ArithmeticError):
        return None
    raise TypeError(f"no cell is a {kind.simpleString()}")


def _named(first: dict[int, object]) -> dict[int, str]:
    """The columns' names by their number: blank ones are numbered, and so are names that come again."""
    names: dict[int, str] = {}
    for k in range(max(first, default=-1) + 1):
        name = _said(first[k]) if k in first else f"_c{k}"
        taken = set(names.values())
        names[k] = next(n for n in (name, *(f"{name}.{i}" for i in range(1, len(taken) + 2))) if n not in taken)
    return names


@dataclass
class Sheet(InputPartition):
    uri: str
    member: str


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.files, self.sheet, self.schema = _files(options["path"]), options.get("sheet"), schema

    def partitions(self) -> list[Sheet]:
        return [Sheet(uri, member) for uri in self.files for member in _chosen(uri, self.sheet)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        arrow, rows = to_arrow_schema(self.schema), _Book(partition.uri).rows(partition.member)
        place = {name: k for k, name in _named(next(rows, {})).items()}
        held: list[dict[int, object]] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([_as(r.get(place.get(f.name)), f.dataType) for r in held], arrow.field(k).type) for k, f in enumerate(self.schema)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for row in rows:
            held.append(row)
            if len(held) == BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


def _files(path: str) -> list[str]:
    """The workbook, or all those of a folder."""
    from pyarrow import fs

    system, base = _opened(path)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return [path]
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(base)) if i.base_name.lower().endswith(".xlsx") and not i.base_name.startswith(("~", ".")))
    if not found:
        raise ValueError(f"no workbook in {path}")
    return [path.rstrip("/") + f[len(base.rstrip("/")) :] for f in found]


def _chosen(uri: str, sheet: str | None) -> list[str]:
    sheets = _Book(uri).sheets
    chosen = [m for n, m in sheets if sheet in ("*", n)] if sheet else [m for _, m in sheets[:1]]
    if not chosen:
        raise ValueError(f"{uri} has no sheet named {sheet!r}, only {[n for n, _ in sheets]}")
    return chosen


# ---------------------------------------------------------------- writing


def _hidden(text: str) -> str:
    text = _HIDDEN.sub(lambda m: f"_x005F_x{m[1]}_", text)
    return escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < 10**DIGITS or isinstance(value, float) and value - value == 0:
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, Decimal) and value.is_finite() and len(value.as_tuple().digits) <= DIGITS:
        return f"<c><v>{value}</v></c>"
    if isinstance(value, dt.datetime):
        since = value.replace(tzinfo=None) - dt.datetime(1899, 12, 30)
        return f'<c s="2"><v>{since / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(value, dt.date):
        return f'<c s="1"><v>{(value - dt.date(1899, 12, 30)).days}</v></c>'
    text = value if isinstance(value, str) else str(value) if isinstance(value, (int, float, Decimal)) else json.dumps(value, default=str, ensure_ascii=False)
    if len(text.encode("utf-16-le")) // 2 > CELL:
        raise ValueError(f"a cell holds {CELL} characters, this text has {len(text)}; cut it first")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_hidden(text)}</t></is></c>'


def _row(values) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


@dataclass
class Part(WriterCommitMessage):
    index: int
    path: str
    rows: int


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.fieldNames(), overwrite
        self.sheet = options.get("sheet") or "Sheet1"
        if len(self.sheet) > NAME or re.search(r"[\[\]:*?/\\]", self.sheet):
            raise ValueError(f"no name of a sheet: {self.sheet!r}")
        folder, _, name = self.path.rstrip("/").rpartition("/")
        self.job = f"{folder}/.{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, base = _opened(self.job)
        index = TaskContext.get().partitionId()
        system.create_dir(base, recursive=True)
        path, rows = f"{base}/{index:06d}-{uuid.uuid4().hex}.xml", 0
        with system.open_output_stream(path) as out:
            for batch in iterator:
                columns = [c.to_pylist() for c in batch.columns]
                for values in zip(*columns):
                    out.write(_row(values).encode())
                rows += batch.num_rows
        return Part(index, path, rows)

    def abort(self, messages) -> None:
        system, base = _opened(self.job)
        system.create_dir(base, recursive=True)
        system.delete_dir(base)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda p: p.index)
        if (rows := sum(p.rows for p in parts)) >= ROWS:
            self.abort(messages)
            raise ValueError(f"a sheet holds {ROWS - 1} rows beside its header, not {rows}")
        from pyarrow import fs

        system, path = _opened(self.path)
        there = system.get_file_info(path).type == fs.FileType.File
        old = _Book(self.path) if there and not self.overwrite else None
        if old and ("docProps/app.xml" not in old.zip.NameToInfo or WRITER.encode() not in old.zip.read("docProps/app.xml")):
            self.abort(messages)
            raise ValueError(f"{self.path} was written by another program; write a workbook of its own")
        kept = [(n, m) for n, m in old.sheets if n != self.sheet] if old else []
        made = f"{_opened(self.job)[1]}.xlsx"
        with system.open_output_stream(made) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
            names = [n for n, _ in kept]
            for k, (_, member) in enumerate(kept, 1):
                with old.zip.open(member) as source, book.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as out:
                    _copy(source, out)
            names.append(self.sheet)
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                out.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{_row(self.names)}'.encode())
                for part in parts:
                    with system.open_input_stream(part.path) as source:
                        _copy(source, out)
                out.write(b"</sheetData></worksheet>")
            for member, text in _frame(names).items():
                book.writestr(member, HEAD + text)
        if there:
            system.delete_file(path)
        system.move(made, path)
        self.abort(messages)  # the fragments


def _copy(source, out) -> None:
    while piece := source.read(1 << 20):
        out.write(piece)


def _frame(names: list[str]) -> dict[str, str]:
    """The parts of a workbook beside its sheets."""
    n = range(1, len(names) + 1)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    sheets = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, names))
    formats = "".join(f'<xf numFmtId="{f}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for f in (0, 14, 22))
    return {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in n) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "docProps/app.xml": f'<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Application>{WRITER}</Application></Properties>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
        + f'<Relationship Id="rId{len(names) + 1}" Type="{LINKS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{formats}</cellXfs></styleSheet>',
    }


class Workbook(DataSource):
    """Format "workbook". path: a workbook, or (to read) a folder of them, on a store that Arrow opens. sheet: its name;
    read without one, the first sheet; "*" reads all. Without a schema all columns are text, named by the first row of
    the first sheet chosen; with one, cells that aren't of their column's type are null. Dates without a time are text
    like 2024-02-29."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        uri = _files(self.options["path"])[0]
        first = next(_Book(uri).rows(_chosen(uri, self.options.get("sheet"))[0]), {})
        return T.StructType([T.StructField(n, T.StringType()) for n in _named(first).values()])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema, overwrite)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    reader = reader.schema(schema) if schema else reader
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def sheet_names(names: list[str]) -> dict[str, str]:
    """A sheet's name for each table's: without characters that it can't hold, cut, and numbered where two would meet."""
    out: dict[str, str] = {}
    for name in names:
        clean = re.sub(r"[\[\]:*?/\\]", "_", name)[:NAME] or "Sheet"
        taken = {n.lower() for n in out.values()}
        out[name] = next(n for n in (clean, *(f"{clean[: NAME - len(str(i)) - 1]}~{i}" for i in range(2, len(names) + 2))) if n.lower() not in taken)
    return out


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """One workbook, anew, with a sheet a table: lists and structs as JSON, text longer than a cell cut with a mark."""
    named = sheet_names(list(tables))
    for k, (name, df) in enumerate(tables.items()):
        df.sparkSession.dataSource.register(Workbook)
        flat = {c: capped_cell(F.to_json(F.col(f"`{c}`"))) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))}
        capped = {c: capped_cell(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"}
        df.withColumns(flat | capped).write.format("workbook").option("sheet", named[name]).mode("append" if k else "overwrite").save(path)
