"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased.  The
documents are taken in batches of falling ``doc_id``.  A batch's keys are reduced to one row
``(k1, k2, n_docs, last_doc)`` each, merge-anti-joined with the runs on keys that are settled
there (already in ``min_docs`` documents; their keeper, having a larger id, is known), and what is
left becomes a run of its own: a table bucketed and sorted by the key hash, so the merge joins
read it without a shuffle.  Whenever ``fanout`` runs stand on a level they are compacted into one
run of the next.  After the last batch one compaction yields the keys found in ``min_docs``
documents or more, each with its keeper, and every document drops the other occurrences.

Keys are 128-bit hashes.  Hot lines are counted by partial aggregation and their join back is a
plain shuffle join, which adaptive execution can split.  Text is shuffled once.

Defined cases: ``doc_id`` is a whole number (batches are ranges of it; any other type is an error); a null or empty text is one empty line; each row counts as a document, so a key
counts once per row and rows that repeat a ``doc_id`` are documents of their own; a null ``doc_id``
ranks below every id; all rows that tie for the largest id keep the line; an empty table gives an
empty result; extra columns stay (names that start with ``__ld_`` are reserved).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Staging, ascii_lower

KEY = ["k1", "k2"]
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("line"), key).alias("k2"))


class LineRuns:
    """Levelled sorted runs of line keys, kept as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.staging = Staging(spark, "line-runs")
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"run{self.made}"
        self.made += 1
        table = f"line_runs_{self.staging.path[-32:]}_{name}"
        (keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
             .option("path", f"{self.staging.path}/{name}").format("parquet").saveAsTable(table))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _merged(self, tables: list[str]) -> DataFrame:
        """Two sorted runs at a time are merged by key (bucketed on both sides: no shuffle).

        Not a union and ``groupBy``: Spark 4.1 takes a union of bucketed scans as already partitioned by
        the key and leaves a key's rows in different tasks."""
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(*KEY, F.col("n_docs").alias("n_b"), F.col("last_doc").alias("last_b"))
            return a.join(b.hint("merge"), KEY, "full").select(
                *KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last_b").alias("last_doc"))

        return reduce(two, [self.spark.table(t) for t in tables])

    def _forget(self, tables: list[str]) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.staging.remove(table.rsplit("_", 1)[-1])

    def add(self, keys: DataFrame) -> None:
        """Take one batch ``(k1, k2, n_docs, last_doc)``, unique by key, whose ids lie below all earlier ones."""
        for table in [t for level in self.levels for t in level]:
            settled = self.spark.table(table).where(F.col("n_docs") >= self.min_docs).select(*KEY)
            keys = keys.join(settled.hint("merge"), KEY, "left_anti")
        self._write(keys, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            self._forget(old)
            level += 1

    def frequent(self) -> DataFrame:
        """The last compaction: keys found in ``min_docs`` documents or more, with their keeper."""
        tables = [t for level in self.levels for t in level]
        found = self.staging.table("frequent", self._merged(tables).where(F.col("n_docs") >= self.min_docs).select(*KEY, "last_doc"))
        self._forget(tables)
        return found


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, plus ``n_lines`` and ``n_dropped`` (before and dropped)."""
    spark = docs.sparkSession
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    runs = LineRuns(spark, min_docs, fanout)
    # batches of falling id; a null id belongs to the last one
    cuts = [] if lo is None else sorted({lo + (hi - lo + 1) * k // batches for k in range(1, batches)} - {lo}, reverse=True)
    above = None
    for cut in [*cuts, None]:
        part = docs.select("doc_id", "text")
        if above is not None:
            part = part.where((F.col("doc_id") < above) | F.col("doc_id").isNull() if cut is None else F.col("doc_id") < above)
        if cut is not None:
            part = part.where(F.col("doc_id") >= cut)
        long_keys = F.array_distinct(F.transform(
            F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars), _hashed))
        keys = (part.select("doc_id", F.explode(long_keys).alias("k")).groupBy("k.k1", "k.k2")
                .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")))
        runs.add(keys)
        above = cut
    frequent = runs.frequent()

    # what each document drops; rows that agree in id and text drop alike
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    spots = (docs.select("doc_id", text_hash.alias("th"), F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("at", "key"))
             .where(F.char_length("key") >= min_chars)
             .select("doc_id", "th", "at", _hashed(F.col("key")).alias("k")).select("doc_id", "th", "at", "k.k1", "k.k2"))
    drops = (spots.join(frequent, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
             .groupBy(F.col("doc_id").alias("__ld_id"), F.col("th").alias("__ld_th"))
             .agg(F.sort_array(F.collect_set("at")).alias("__ld_at")))
    rows = docs.withColumn("__ld_hash", text_hash)
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("__ld_id")) & (F.col("__ld_hash") == F.col("__ld_th")), "left")
    lines = _lines(F.col("text"))
    bounds = F.concat(F.array(F.lit(-1)), F.col("__ld_at"), F.array(F.size(lines)))
    kept = F.flatten(F.transform(  # the stretches between dropped lines
        F.sequence(F.lit(1), F.size(F.col("__ld_at")) + 1),
        lambda i: F.slice(F.col("__ld_lines"), F.element_at(F.col("__ld_bounds"), i) + 2,
                          F.element_at(F.col("__ld_bounds"), i + 1) - F.element_at(F.col("__ld_bounds"), i) - 1)))
    n_lines = F.size(lines).cast("long")
    return (joined.withColumn("n_lines", n_lines)
            .withColumn("n_dropped", F.coalesce(F.size("__ld_at"), F.lit(0)).cast("long"))
            .withColumn("__ld_lines", F.when(F.col("__ld_at").isNotNull(), lines))
            .withColumn("__ld_bounds", F.when(F.col("__ld_at").isNotNull(), bounds))
            .withColumn("text", F.when(F.col("__ld_at").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.concat_ws("\n", kept)))
            .drop("__ld_hash", "__ld_id", "__ld_th", "__ld_at", "__ld_lines", "__ld_bounds"))


def line_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns from ``line_dedup``."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, line, pos,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, line, pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
