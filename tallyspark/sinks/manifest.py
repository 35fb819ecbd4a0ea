"""Artifacts: manifest, failure policy.

* K11 -- size and content digest of what was written.  The report is taken as one stream of
  bytes, its files in partition-number order, cut into ``BLOCK`` bytes; every block is hashed in
  the task that reads it, and the block digests are folded, ``FOLD`` at a time, into one.  The digest
  depends on the report's bytes alone: not on how many part files hold them.
* K10 -- a dry run goes through the real writer into scratch, is measured the same way, and the
  scratch is deleted.
* K12 -- a write under the ``optional`` policy records a failure instead of raising.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import OPTIONAL_FAILURE

log = logging.getLogger(__name__)

BLOCK = 1 << 20
RANGE = 64 * BLOCK  # bytes of one file that one row of work covers
FOLD = 1024


@dataclass
class Artifact:
    mode: str  # "filesystem" | "noop"
    available: bool
    reason: str | None = None
    size_bytes: int | None = None
    checksum: str | None = None
    key: str | None = None
    entries: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, begins`` of each part file under ``path`` (recursively), from metadata only.

    ``begins`` is the file's first byte in the report: folder by folder, in the order of the number in
    ``part-<n>`` (a plain name sort puts ``part-100000`` before ``part-99999``).  One row per file."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "{part-*,*.xlsx}").option("recursiveFileLookup", "true").load(path)
        .select("path", "length")
    )
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1)
    order = Window.orderBy(F.regexp_extract("path", r"^(.*)/", 1), F.when(number != "", number.cast("long")).otherwise(-1), "path")
    return files.withColumn("begins", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def _pieces(begins: int, read: Callable[[int], bytes]) -> Iterator[tuple[int, int, bytes]]:
    """``(block, place in the block, bytes)`` of a stretch that starts at byte ``begins`` of the report."""
    at = begins
    while data := read(BLOCK - at % BLOCK):
        yield at // BLOCK, at % BLOCK, data
        at += len(data)


def _digest_pieces(pieces: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Whole blocks as their digest, partial ones as bytes."""
    for block, at, data in pieces:
        whole = len(data) == BLOCK
        columns = [[block], [at], [None if whole else data], [hashlib.sha256(data).digest() if whole else None]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                         names=["block", "at", "data", "digest"])


def _full(read: Callable[[int], bytes]) -> Callable[[int], bytes]:
    """A reader that returns fewer bytes only at the end."""
    def whole(n: int) -> bytes:
        out = b""
        while len(out) < n and (more := read(n - len(out))):
            out += more
        return out
    return whole


def _block_rows(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """``(block, at, data, digest)`` of the whole report, read in ranges by the tasks.

    Where Arrow cannot open the store, Spark's binary reader is used, a file (of at most 2 GiB) at a time."""
    import io

    from .workbook import _open_store, qualified

    schema = "block long, at long, data binary, digest binary"
    try:
        _open_store(qualified(spark, path))[0].get_file_info(_open_store(qualified(spark, path))[1])
    except Exception as e:  # noqa: BLE001
        log.info("read through Spark: %s", e)
        contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
        placed = contents.join(F.broadcast(files.select("path", "begins")), "path").select("begins", "content")  # one row per file

        def from_content(batches):
            for batch in batches:
                for begins, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from _digest_pieces(_pieces(begins, io.BytesIO(content.as_py()).read))

        return placed.mapInArrow(from_content, schema)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long")))
    ranges = files.where("length > 0").select("path", "begins", "length", starts.alias("start"))
    ranges = ranges.repartition("path", "start")

    def from_store(batches):
        for batch in batches:
            for path_, begins, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = _open_store("file://" + path_[len("file:"):] if path_.startswith("file:/") and not path_.startswith("file://") else path_)
                with store.open_input_file(inner) as f:
                    f.seek(start)
                    left = [min(RANGE, length - start)]

                    def read(n, f=f, left=left):
                        data = f.read(min(n, left[0]))
                        left[0] -= len(data)
                        return data

                    yield from _digest_pieces(_pieces(begins + start, _full(read)))

    return ranges.mapInArrow(from_store, schema)


def _joined(order: str, value: str):
    """Binary values of a group, concatenated by ``order`` (a block's bytes, or ``FOLD`` digests)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.aggregate(listed, F.lit(b""), lambda a, x: F.concat(a, x["v"]))


def manifest_digest(spark: SparkSession, path: str, checksum: bool = True) -> tuple[int, str | None, DataFrame]:
    """Total size, content digest and the list of files.  The driver sees two values.

    Without ``checksum`` only file metadata is read."""
    files = part_files(spark, path)
    size = int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    if not checksum:
        return size, None, files
    blocks = -(-size // BLOCK)
    rows = _block_rows(spark, files, path)
    level = rows.groupBy("block").agg(F.coalesce(F.max("digest"), F.unhex(F.sha2(_joined("at", "data"), 256))).alias("digest"))
    while blocks > 1:
        blocks = -(-blocks // FOLD)
        level = level.groupBy(F.floor(F.col("block") / FOLD).alias("block_")).agg(F.unhex(F.sha2(_joined("block", "digest"), 256)).alias("digest")).withColumnRenamed("block_", "block")
    top = level.select(F.lower(F.hex("digest")).alias("digest")).first()
    return size, top.digest if top else hashlib.sha256(b"").hexdigest(), files


def with_policy(policy: str, action: Callable[[], Artifact], key: str) -> Artifact:
    """``required`` re-raises; ``optional`` returns an unavailable artifact."""
    try:
        return action()
    except Exception as e:  # noqa: BLE001
        if policy == "required":
            raise
        log.warning("optional write failed for %s: %s", key, e)
        return Artifact(mode="filesystem", available=False, reason=OPTIONAL_FAILURE, key=key)
