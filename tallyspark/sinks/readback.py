"""Read written report entries back (row counts per entry, for checks and run records)."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _xlsx_rows(batches):
    for pdf in batches:
        counts = []
        for content in pdf["content"]:
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                sheet = z.read("xl/worksheets/sheet1.xml")
            counts.append(max(0, sheet.count(b"<row ") - 1))  # minus the header row
        yield pd.DataFrame({"n_rows": pd.Series(counts, dtype="int64")})


def _csv_records(batches):
    """Record ends of each part file: newlines outside quotes (no record spans two files)."""
    for pdf in batches:
        counts = []
        for content in pdf["content"]:
            data = np.frombuffer(bytes(content), dtype=np.uint8)
            inside = np.cumsum(data == ord('"')) % 2
            counts.append(int(((data == 10) & (inside == 0)).sum()))
        yield pd.DataFrame({"n": pd.Series(counts, dtype="int64")})


def _xlsx_cells(batches):
    """Every cell of every sheet, element by element: a sheet is never held as a tree."""
    names = ["path", "row", "letter", "kind", "value"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            out = []
            with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z, z.open("xl/worksheets/sheet1.xml") as sheet:
                for _, node in ElementTree.iterparse(sheet):
                    tag = node.tag.rpartition("}")[2]
                    if tag == "c":
                        ref = node.get("r")
                        letter = ref.rstrip("0123456789")
                        out.append((path, int(ref[len(letter):]), letter, {"inlineStr": "s", "b": "b"}.get(node.get("t"), "n"), "".join(node.itertext())))
                    elif tag == "row":
                        node.clear()
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _CELLS)
                            out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _CELLS)


_CELLS = pa.schema([("path", pa.string()), ("row", pa.int64()), ("letter", pa.string()), ("kind", pa.string()), ("value", pa.string())])


def workbook_cells(books: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, row, letter, kind, value)`` of every cell of workbooks given as bytes; row 1 is the header, kind n, s or b."""
    return books.select(F.col(path).cast("string"), F.col(content)).mapInArrow(_xlsx_cells, "path string, row long, letter string, kind string, value string")


def entry_rows(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One row ``n_rows``: data rows in a written entry (framing lines excluded)."""
    if fmt == "xlsx":
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
        per_file = files.mapInPandas(_xlsx_rows, T.StructType([T.StructField("n_rows", T.LongType())]))
        return per_file.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_rows"))
    if fmt == "csv":
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
        records = files.mapInPandas(_csv_records, T.StructType([T.StructField("n", T.LongType())])).agg(F.sum("n").alias("lines"))
        return records.select(F.greatest(F.coalesce("lines", F.lit(0)) - F.lit(1), F.lit(0)).cast("long").alias("n_rows"))
    lines = spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))
    framing = 0 if fmt == "pdf" else 1  # json closing bracket
    return lines.select(F.greatest(F.col("lines") - F.lit(framing), F.lit(0)).cast("long").alias("n_rows"))
