"""Workbooks (K4): one XLSX per group, split into parts, streamed in parallel.

A sheet holds at most 1,048,576 rows (one header + 1,048,575 data rows), so rows are first
numbered inside their group (distributed: ``number_rows_within``) and cut into parts of at
most ``part_rows``.  Parts are dealt to tasks; each task streams its rows in order, batch by batch,
into an incremental deflate, so no task holds a sheet, and a group with a third of all rows becomes many parts on
many tasks.  A sheet whose text reaches ``PIECE_BYTES`` ends there and goes on in a further piece.

File names hold the group's values in an encoding that no two groups share and that cannot leave the folder.

The file is minimal SpreadsheetML written with the standard ``zipfile`` module: one sheet
named ``Report``, a header row, inline strings, no styles; a null is an empty cell.
"""

from __future__ import annotations

import decimal
import hashlib
import io
import math
import zipfile
from collections.abc import Iterator, Sequence
from typing import Any, BinaryIO
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import TEMPORAL, iso_text, json_value, number_text, qcol
from ..operators.ordering import number_rows, number_rows_within

EXCEL_MAX_DATA_ROWS = 1_048_575
PIECE_BYTES = 1 << 30  # sheet text in one file; well below what a zip entry holds without extensions
SLICE_ROWS = 2_000

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# The package parts of a one-sheet workbook.
CONTENT_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    "</Types>"
)
ROOT_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
    "</Relationships>"
)
WORKBOOK = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Report" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
WORKBOOK_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
    "</Relationships>"
)
SHEET_HEAD = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
)
SHEET_TAIL = "</sheetData></worksheet>"


def column_letter(i: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _xml_text(s: pd.Series) -> pd.Series:
    return (
        s.str.replace("&", "&amp;", regex=False)
        .str.replace("<", "&lt;", regex=False)
        .str.replace(">", "&gt;", regex=False)
        .str.replace(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", regex=True)
    )


def _number_text(v: float) -> str:
    if v == math.floor(v) and abs(v) < 1e21:
        return str(int(v))
    return repr(float(v))


def _cells(col: pd.Series, letter: str, rownums: pd.Series, kind: str | None = None) -> pd.Series:
    """Cell XML for one column (empty string for a null).  ``kind`` comes from the Spark
    schema: ``n`` = number already rendered as text on the JVM, ``b`` = boolean, ``s`` = text;
    without it the kind is guessed from the pandas dtype."""
    ref = '<c r="' + letter + rownums
    null = col.isna()
    if kind == "n":
        return (ref + '"><v>' + col.astype(object).where(~null, "").astype(str) + "</v></c>").where(~null, "")
    if kind == "s":
        text = col.astype(str).where(~null, "")
        return (ref + '" t="inlineStr"><is><t xml:space="preserve">' + _xml_text(text) + "</t></is></c>").where(~null, "")
    if col.dtype == object and len(col.dropna()) and col.dropna().map(lambda v: isinstance(v, decimal.Decimal)).all():
        col = col.map(lambda v: None if v is None else float(v)).astype("float64")
    if pd.api.types.is_bool_dtype(col) or (col.dtype == object and col.dropna().map(type).eq(bool).all() and len(col.dropna())):
        body = ref + '" t="b"><v>' + col.map(lambda b: "1" if b else "0") + "</v></c>"
    elif pd.api.types.is_numeric_dtype(col):
        finite = col.astype("float64")
        ok = np.isfinite(finite)
        null = null | ~ok
        text = finite.where(ok, 0.0).map(_number_text)
        body = ref + '"><v>' + text + "</v></c>"
    else:
        text = col.astype(str).where(~null, "")
        body = ref + '" t="inlineStr"><is><t xml:space="preserve">' + _xml_text(text) + "</t></is></c>"
    return body.where(~null, "")


class _Hashed:
    """A write-only stream that forwards to another and keeps length and digest."""

    def __init__(self, out: BinaryIO):
        self.out, self.length, self.digest = out, 0, hashlib.sha256()

    def write(self, data) -> int:
        self.out.write(data)
        self.length += len(data)
        self.digest.update(data)
        return len(data)

    def flush(self) -> None:
        pass


class SheetWriter:
    """One workbook, written in slices of rows; ``sheet_bytes`` is the sheet's text so far."""

    def __init__(self, out: BinaryIO, columns: Sequence[str], kinds: Sequence[str] | None = None):
        self.columns, self.kinds, self.n_rows, self.sheet_bytes = columns, kinds, 0, 0
        self.hashed = _Hashed(out)
        self.zip = zipfile.ZipFile(self.hashed, "w", zipfile.ZIP_DEFLATED)
        for name, text in (("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", ROOT_RELS), ("xl/workbook.xml", WORKBOOK), ("xl/_rels/workbook.xml.rels", WORKBOOK_RELS)):
            self.zip.writestr(name, text)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w")
        header = "".join(f'<c r="{column_letter(i)}1" t="inlineStr"><is><t>{_xml_text(pd.Series([c]))[0]}</t></is></c>' for i, c in enumerate(columns))
        self._text(SHEET_HEAD + (f'<row r="1">{header}</row>' if columns else ""))

    def _text(self, text: str) -> None:
        data = text.encode()
        self.sheet_bytes += len(data)
        self.sheet.write(data)

    def rows(self, pdf: pd.DataFrame) -> None:
        for at in range(0, len(pdf), SLICE_ROWS):
            part = pdf.iloc[at : at + SLICE_ROWS]
            rownums = pd.Series(np.arange(self.n_rows + 2, self.n_rows + len(part) + 2), index=part.index).astype(str)
            row_xml = pd.Series("", index=part.index)
            for i, c in enumerate(self.columns):
                row_xml = row_xml + _cells(part[c], column_letter(i), rownums, self.kinds[i] if self.kinds else None)
            self._text(("<row r=\"" + rownums + "\">" + row_xml + "</row>").str.cat())
            self.n_rows += len(part)

    def close(self) -> None:
        self._text(SHEET_TAIL)
        self.sheet.close()
        self.zip.close()


def render_workbook(columns: Sequence[str], pdf: pd.DataFrame, kinds: Sequence[str] | None = None) -> bytes:
    """One workbook from an ordered pandas frame (header row first).  With no columns the
    sheet is empty -- what a report without rows gives (its header comes from a first row)."""
    buf = io.BytesIO()
    writer = SheetWriter(buf, columns, kinds)
    writer.rows(pdf)
    writer.close()
    return buf.getvalue()


class _Numbered:
    """The rows of all parts as text cells, dealt out by part and in order: groups, ``part``, ``__row`` (0 begins a part), ``__first``, cells."""

    def __init__(self, df: DataFrame, group_cols: Sequence[str], order: Sequence[Column | str], columns: Sequence[str] | None, part_rows: int):
        if not 1 <= part_rows <= EXCEL_MAX_DATA_ROWS:
            raise ValueError(f"part_rows must be in 1..{EXCEL_MAX_DATA_ROWS}")
        self.schema, self.groups = df.schema, list(group_cols)
        self.columns = list(columns or [c for c in df.columns if c not in group_cols])
        self.kinds = [self._kind(c) for c in self.columns]
        order_names = [f"__o{i}" for i in range(len(order))]
        names = [f"__c_{i}" for i in range(len(self.columns))]
        # Cells become text; group and order keys keep their values, so Spark's order is the only one.
        view = df.select(
            *[qcol(g) for g in self.groups],
            *[(qcol(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, order_names)],
            *[self._cell(c).alias(n) for c, n in zip(self.columns, names)],
        )
        numbered = number_rows_within(view, self.groups, order_names, "__rn") if self.groups else number_rows(view, order_names, "__rn")
        first_type = numbered.schema[order_names[0]].dataType if order_names else T.NullType()
        first = iso_text(F.col(order_names[0]), first_type) if isinstance(first_type, TEMPORAL) else F.col(order_names[0]) if order_names else F.lit(None)
        keys = [qcol(g) for g in self.groups]
        self.rows = (numbered.select(*keys, F.floor((F.col("__rn") - 1) / part_rows).cast("int").alias("part"), ((F.col("__rn") - 1) % part_rows).alias("__row"),
                                     first.cast("string").alias("__first"), *names)
                     .repartition(*keys, "part").sortWithinPartitions(*keys, "part", "__row"))

    def _cell(self, c: str) -> Column:  # numbers as JavaScript text, times as ISO text, nested values as JSON text
        dtype = self.schema[c].dataType
        if isinstance(dtype, NUMERIC):
            return number_text(qcol(c), dtype)
        if isinstance(dtype, TEMPORAL):
            return iso_text(qcol(c), dtype)
        if isinstance(dtype, T.BinaryType):
            return F.base64(qcol(c))
        return json_value(qcol(c), dtype) if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)) else qcol(c)

    def _kind(self, c: str) -> str:
        dtype = self.schema[c].dataType
        return "n" if isinstance(dtype, NUMERIC) else "b" if isinstance(dtype, T.BooleanType) else "s"


def _streamed(batches: Iterator[pa.RecordBatch], n_groups: int, columns: Sequence[str], kinds: Sequence[str], open_book) -> Iterator[pa.RecordBatch]:
    """Rows of whole parts, in order, through one open workbook at a time.

    ``open_book(keys, part, piece)`` gives a stream; when its workbook is complete, ``done(writer, first)`` of it makes a batch."""
    book = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(batch.column(n_groups + 1).to_numpy() == 0)
        cells = pa.RecordBatch.from_arrays(batch.columns[n_groups + 3 :], names=[str(i) for i in range(len(columns))]).to_pandas()
        cells.columns = columns
        for at, end in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows]):
            while at < end:
                begins = at in starts
                if begins or book is None or book.writer.sheet_bytes >= PIECE_BYTES:
                    piece = 0 if begins or book is None else book.piece + 1
                    if book is not None:
                        yield book.close()
                    book = open_book([batch.column(i).slice(at, 1) for i in range(n_groups)], batch.column(n_groups)[at].as_py(), piece, batch.column(n_groups + 2)[at].as_py())
                    starts = starts[starts != at]
                until = min(end, at + SLICE_ROWS)
                book.writer.rows(cells.iloc[at:until])
                at = until
    if book is not None:
        yield book.close()


class _Content:
    """A workbook kept in memory and returned as a row."""

    def __init__(self, names, columns, kinds, keys, part, piece, first):
        self.names, self.keys, self.part, self.piece, self.first = names, keys, part, piece, first
        self.buffer = io.BytesIO()
        self.writer = SheetWriter(self.buffer, columns, kinds)

    def close(self) -> pa.RecordBatch:
        self.writer.close()
        made = [pa.array([self.part], pa.int32()), pa.array([self.piece], pa.int32()), pa.array([self.writer.n_rows], pa.int64()), pa.array([self.first], pa.string()), pa.array([self.buffer.getvalue()], pa.binary())]
        return pa.RecordBatch.from_arrays([*self.keys, *made], names=[*self.names, "part", "piece", "n_rows", "first_key", "content"])


class _File:
    """A workbook streamed into a file; closing it gives its manifest row."""

    def __init__(self, fs, root, shown, name, columns, kinds, piece):
        self.piece, self.shown = piece, f"{shown}/{name}"
        fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(f"{root}/{name}")
        self.writer = SheetWriter(self.stream, columns, kinds)

    def close(self) -> pa.RecordBatch:
        self.writer.close()
        self.stream.close()
        out = self.writer.hashed
        return pa.RecordBatch.from_arrays([pa.array([self.shown]), pa.array([self.writer.n_rows], pa.int64()), pa.array([out.length], pa.int64()), pa.array([out.digest.hexdigest()])],
                                          names=["file", "n_rows", "length", "sha256"])


def workbooks(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column | str],
    columns: Sequence[str] | None = None,
    part_rows: int = EXCEL_MAX_DATA_ROWS,
) -> DataFrame:
    """K4: ``(*group_cols, part, piece, n_rows, first_key, content)`` -- one XLSX per group part (and piece of it);
    ``first_key`` is the first row's (first) order key as text, an index of the parts."""
    numbered = _Numbered(df, group_cols, order, columns, part_rows)
    names, cols, kinds = numbered.groups, numbered.columns, numbered.kinds
    out_schema = T.StructType(
        [T.StructField(g, df.schema[g].dataType) for g in names]
        + [T.StructField("part", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("n_rows", T.LongType()),
           T.StructField("first_key", T.StringType()), T.StructField("content", T.BinaryType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streamed(batches, len(names), cols, kinds, lambda keys, part, piece, first: _Content(names, cols, kinds, keys, part, piece, first))

    return numbered.rows.mapInArrow(work, out_schema)


def group_name(values: Sequence[Any], separator: str = "-") -> str:
    """The values as one file name, another for each other group: letters, digits, ``_`` and (inside) ``.`` stand for
    themselves, all else is percent-encoded, and null is ``%null``.  A name too long for a file ends in its digest."""
    def encode(v: Any) -> str:
        if v is None:
            return "%null"
        text = quote(v.hex() if isinstance(v, bytes) else str(v), safe="").replace("-", "%2D").replace("~", "%7E")
        return "%2E" + text[1:] if text.startswith(".") else text

    name = separator.join(encode(v) for v in values)
    return name if len(name) <= 180 else f"{name[:100]}%{hashlib.sha256(name.encode()).hexdigest()}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the session's file system, as the text sinks resolve it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = target.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _open_store(uri: str):
    """``(file system, root)`` of a qualified path; Hadoop's S3 schemes are plain s3 to Arrow."""
    import pyarrow.fs as pafs

    for hadoop_scheme in ("s3a://", "s3n://"):
        if uri.startswith(hadoop_scheme):
            uri = "s3://" + uri[len(hadoop_scheme):]
    return pafs.FileSystem.from_uri(uri)


def write_workbooks(
    df: DataFrame, path: str, group_cols: Sequence[str], order: Sequence[Column | str], columns: Sequence[str] | None = None,
    part_rows: int = EXCEL_MAX_DATA_ROWS, prefix: str = "report", folder_per_group: bool = False,
) -> DataFrame:
    """Stream each workbook part into ``<path>/<prefix>[-<group>]-part<k>[-<piece>].xlsx`` (or, with
    ``folder_per_group``, ``<path>/<col>=<value>/<prefix>-part<k>.xlsx``) from the executors
    (``pyarrow.fs`` understands local, HDFS and object-store URIs).  Names are fixed by
    (group, part), so a retried task overwrites its own file; ``group_name`` keeps them apart.  Returns the lazy manifest
    ``file, n_rows, length, sha256`` -- one row per file; running it writes the files."""
    numbered = _Numbered(df, group_cols, order, columns, part_rows)
    names, cols, kinds = numbered.groups, numbered.columns, numbered.kinds
    uri, shown = qualified(df.sparkSession, path), path.rstrip("/")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_store(uri)

        def open_book(keys, part, piece, first):
            values = [k[0].as_py() for k in keys]
            tail = f"part{part:05d}{f'-{piece}' if piece else ''}.xlsx"
            if folder_per_group:
                name = "/".join([*[f"{group_name([g])}={group_name([v])}" for g, v in zip(names, values)], f"{prefix}-{tail}"])
            else:
                name = "-".join([prefix, *([group_name(values)] if names else []), tail])
            return _File(fs, root.rstrip("/"), shown, name, cols, kinds, piece)

        return _streamed(batches, len(names), cols, kinds, open_book)

    return numbered.rows.mapInArrow(work, "file string, n_rows long, length long, sha256 string")


def write_empty_workbook(spark: SparkSession, path: str, name: str = "report-part00000.xlsx") -> str:
    """The workbook of a report without rows: one empty ``Report`` sheet (a single small
    file, written from the driver)."""
    fs, root = _open_store(qualified(spark, path))
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as f:
        f.write(render_workbook([], pd.DataFrame()))
    return f"{path.rstrip('/')}/{name}"
