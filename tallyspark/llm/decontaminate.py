"""Benchmark decontamination with suffix arrays over shards of the training text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, compared by 64-bit hashes.  A
window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
window.  Each task cuts its documents into shards, builds a word-level suffix array of every shard
and binary-searches all test suffixes in it.  Matches of ``width`` words or more that continue each
other are joined into the longest verbatim matches with their places in document and item.

A shard's suffix array leaves out suffixes that cannot start a match: those whose first word, or
one of the following ones up to the shortest window, is in no item.

The items are written as a table with a block number each, by a running sum of their sizes, and a block goes to the tasks as
its items' rows (a broadcast of at most ``block_words`` words, or one longer item).  One test set is alive at a time: each block is
a pass over the documents whose findings (rows with hits alone) are written before the next begins, then merged
per document.  Documents themselves are never shuffled.

Occurrences are kept per distinct window; items are named once per (document, window), and matches are built only where asked for, so
a passage that many items share costs its occurrences, not occurrences times items.

Defined cases: a null or empty text has no words, no hits and is not contaminated; null or
word-less items have no windows; a null ``item_id`` is shown as an empty string; items of equal
text, and rows that repeat an ``item_id``, each match (ids count once); rows that repeat a ``doc_id``
are documents of their own; an empty table on either side gives no hits; extra columns stay
(the names ``n_words n_hit items matches hit_spans contaminated`` are replaced, names that start with ``__dc_`` are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging, bounded_batches
from .tokens import ALNUM_WORD, Slice, slices

SHARD_BYTES = 4 << 20
MATCH = "struct<item_id:string,doc_word:long,item_word:long,words:long>"
ADDED = f"n_words long, n_hit long, items array<string>, matches array<{MATCH}>, hit_spans array<struct<begin:long,until:long>>"
MATCH_ARROW = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())])
SPAN_ARROW = pa.struct([("begin", pa.int64()), ("until", pa.int64())])


class TestSet:
    """One block of items: their words as ranks in the block's vocabulary, and every window's start and width."""

    __test__ = False

    def __init__(self, ids: list, texts: list, width: int):
        self.width = width
        words, owner, base = [], [], 0
        for part in slices(pa.array(texts, pa.string())):
            starts, ends = part.words(ALNUM_WORD)
            words.append(part.hashes(starts, ends, lower=True))
            owner.append(part.row_of(starts) + part.first)
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.ids = np.array(["" if i is None else str(i) for i in ids], dtype=object)
        self.vocabulary = np.unique(words)
        self.words = np.searchsorted(self.vocabulary, words).astype(np.int32)
        bounds = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        length = np.diff(bounds)
        starts = [np.arange(b, max(b + 1, e - width + 1)) for b, e in zip(bounds[:-1], bounds[1:]) if e > b]
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.item = self.owner[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.size = np.minimum(length[self.item], width) if len(self.starts) else np.zeros(0, np.int64)
        self.item_word = self.starts - bounds[:-1][self.item] if len(self.starts) else np.zeros(0, np.int64)
        padded = np.concatenate([self.words, np.full(width, -1, np.int32)])
        self.queries = padded[self.starts[:, None] + np.arange(width)] if len(self.starts) else np.zeros((0, width), np.int32)
        self.queries = np.where(np.arange(width) < self.size[:, None], self.queries, -1)
        # equal windows are searched once
        self.distinct, self.same = np.unique(self.queries, axis=0, return_inverse=True) if len(self.queries) else (self.queries, self.starts)
        self.same = np.asarray(self.same).reshape(-1)
        self.same = np.asarray(self.same, np.int64)
        self.shortest = int(self.size.min()) if len(self.size) else width
        # per distinct window its width, its items (each once), and all places where it stands
        n = len(self.distinct)
        self.width_of = (self.distinct >= 0).sum(axis=1) if n else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([self.same, self.item], axis=1), axis=0) if n else np.zeros((0, 2), np.int64)
        self.item_bounds, self.items = np.searchsorted(pairs[:, 0], np.arange(n + 1)), pairs[:, 1]
        self.windows = np.argsort(self.same, kind="stable") if n else np.zeros(0, np.int64)
        self.window_bounds = np.searchsorted(self.same[self.windows], np.arange(n + 1)) if n else np.zeros(1, np.int64)


def suffix_array(ranks: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` sorted by their next ``depth`` words (prefix doubling; ``ranks`` ends with -1 padding)."""
    n = len(ranks)
    order_of = ranks.astype(np.int64) + 1
    have = 1
    while have < depth:
        later = np.zeros(n, np.int64)
        later[: n - have] = order_of[have:]
        key = order_of * (int(order_of.max(initial=0)) + 1) + later
        _, order_of = np.unique(key, return_inverse=True)
        have *= 2
    return at[np.argsort(order_of[at], kind="stable")]


def _compare(text: np.ndarray, at: np.ndarray, query: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the text's words at ``at`` sort before, start with, or sort after the query's words."""
    width = query.shape[1]
    have = text[at[:, None] + np.arange(width)]
    differs = (have != query) & (query >= 0)
    first = differs.argmax(axis=1)
    rows = np.arange(len(at))
    return np.where(differs.any(axis=1), np.sign(have[rows, first] - query[rows, first]), 0)


def search(text: np.ndarray, suffixes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of the suffix array whose suffixes start with it (all binary searches step together)."""
    ends = []
    for past in (False, True):  # first suffix not below, first suffix above
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(suffixes), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            c = _compare(text, suffixes[mid], queries[open_])
            below = c < 0 if not past else c <= 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        ends.append(lo)
    return ends[0], ends[1]


def match_slice(part: Slice, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word count per text; and for every occurrence of a distinct window its first word (flat) and the window's number."""
    starts, ends = part.words(ALNUM_WORD)
    words, rows = part.hashes(starts, ends, lower=True), part.row_of(starts)
    count = np.bincount(rows, minlength=part.rows)
    none = np.zeros(0, np.int64)
    if not len(words) or not len(tests.starts):
        return count, none, none
    at = np.searchsorted(tests.vocabulary, words)
    known = tests.vocabulary[np.minimum(at, len(tests.vocabulary) - 1)] == words
    ranks = np.where(known, at, -1).astype(np.int32)
    # words from each place to the end of its run of known words inside its text
    stop = np.ones(len(ranks) + 1, bool)
    stop[:-1] = ~known
    stop[1:-1] |= rows[1:] != rows[:-1]
    stops = np.flatnonzero(stop)
    here = np.arange(len(ranks))
    following = stops[np.searchsorted(stops, here, side="right")] - here
    candidates = np.flatnonzero(known & (following >= tests.shortest))
    if not len(candidates):
        return count, none, none
    # the shard: the candidates' runs one after another, each closed by width words of padding, so no match leaves its text
    width = tests.width
    new_run = np.ones(len(candidates), bool)
    new_run[1:] = (np.diff(candidates) != 1) | (rows[candidates[1:]] != rows[candidates[:-1]])
    heads = candidates[new_run]
    lengths = following[heads]
    room = lengths + width
    base = np.concatenate([[0], np.cumsum(room)[:-1]])
    shard = np.full(int(room.sum()), -1, np.int32)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    shard[np.repeat(base, lengths) + inner] = ranks[np.repeat(heads, lengths) + inner]
    run = np.cumsum(new_run) - 1
    place = base[run] + candidates - heads[run]
    original = np.full(len(shard), -1, np.int64)
    original[place] = candidates
    suffixes = suffix_array(shard, place, width)
    lo, hi = search(shard, suffixes, tests.distinct)
    found = hi - lo
    return count, original[suffixes[_ranges(lo, found)]], np.repeat(np.arange(len(found)), found)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of ``size[0]`` numbers, then the same of the next."""
    return np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _longest(tests: TestSet, word: np.ndarray, window: np.ndarray, first: np.ndarray, n: int) -> pa.Array:
    """Longest matches per text: occurrences of every item's windows that continue each other on one diagonal of (text, item)."""
    many = tests.window_bounds[window + 1] - tests.window_bounds[window]
    word, window = np.repeat(word, many), tests.windows[_ranges(tests.window_bounds[window], many)]
    row, size, item = np.searchsorted(first, word, side="right") - 1, tests.size[window], tests.item[window]
    order = np.lexsort((word, word - tests.starts[window], item))
    word, window, item, size, row = word[order], window[order], item[order], size[order], row[order]
    head = np.ones(len(word), bool)
    head[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (np.diff(word) != 1) | (np.diff(window) != 1)
    heads = np.flatnonzero(head)
    tails = np.concatenate([heads[1:], [len(word)]])[: len(heads)] - 1
    m_row, m_item, m_in = row[heads], item[heads], tests.item_word[window[heads]]
    m_doc, m_words = word[heads] - first[m_row], word[tails] + size[tails] - word[heads]
    by = np.lexsort((m_in, m_doc, m_item, m_row))
    values = pa.StructArray.from_arrays([pa.array(tests.ids[m_item[by]], pa.string()), pa.array(m_doc[by], pa.int64()), pa.array(m_in[by], pa.int64()), pa.array(m_words[by], pa.int64())], fields=list(MATCH_ARROW))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(m_row[by], np.arange(n + 1)).astype(np.int32)), values)


def _document_columns(part: Slice, tests: TestSet, matches: bool) -> list[pa.Array]:
    """The added columns for one slice's texts."""
    count, word, window = match_slice(part, tests)
    n = part.rows
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.searchsorted(first, word, side="right") - 1
    # hit words: coverage of the flat word positions
    total = int(first[-1])
    covered = np.cumsum(np.bincount(word, minlength=total + 1) - np.bincount(word + tests.width_of[window], minlength=total + 1))[:-1] > 0
    so_far = np.concatenate([[0], np.cumsum(covered)])
    n_hit = so_far[first[1:]] - so_far[first[:-1]]
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    begins, untils = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a covered stretch may run over a text's end into the next text's start
    cuts = np.intersect1d(first[1:-1], np.flatnonzero(covered[1:] & covered[:-1]) + 1)
    begins, untils = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([untils, cuts]))
    span_row = np.searchsorted(first, begins, side="right") - 1
    # items: each distinct window of a text is named once
    held = np.unique(np.stack([row, window], axis=1), axis=0) if len(word) else np.zeros((0, 2), np.int64)
    many = tests.item_bounds[held[:, 1] + 1] - tests.item_bounds[held[:, 1]] if len(held) else np.zeros(0, np.int64)
    of = tests.items[_ranges(tests.item_bounds[held[:, 1]], many)] if len(held) else np.zeros(0, np.int64)
    ends = np.searchsorted(np.repeat(held[:, 0], many), np.arange(n + 1))
    names = pa.array([sorted(set(tests.ids[of[a:b]])) for a, b in zip(ends[:-1], ends[1:])], pa.list_(pa.string()))
    spans = pa.StructArray.from_arrays([pa.array(begins - first[span_row], pa.int64()), pa.array(untils - first[span_row], pa.int64())], fields=list(SPAN_ARROW))
    found = _longest(tests, word, window, first, n) if matches else pa.array([None] * n, pa.list_(MATCH_ARROW))
    return [pa.array(count.astype(np.int64)), pa.array(n_hit.astype(np.int64)), names, found,
            pa.ListArray.from_arrays(pa.array(np.searchsorted(span_row, np.arange(n + 1)).astype(np.int32)), spans)]


def _numbered_items(benchmark: DataFrame, staging: Staging, block_words: int) -> tuple[DataFrame, int]:
    """``(item_id, text, block)`` as a written table, and the number of blocks (of about ``block_words`` words, dealt by a hash)."""
    sized = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    words = sized.agg(F.sum(F.floor(F.char_length("text") / 2) + 1)).first()[0] or 0  # no text has more words
    blocks = max(1, -(-int(words) // block_words))
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks)).cast("int")
    return staging.table("items", sized.withColumn("block", block), "block"), blocks


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_words: int = 2_000_000, matches: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside occurrences of windows), ``items`` (sorted ids), ``matches`` (null if not asked for) and ``contaminated``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("n_words", "n_hit", "items", "matches", "hit_spans", "contaminated")
    place = docs.columns.index("text")
    fields = [f"`{c.replace('`', '``')}` {t}" for c, t in docs.dtypes]
    staging = Staging(spark, "decontaminate")
    items, blocks = _numbered_items(benchmark, staging, block_words)

    def shared_set(block: int):
        rows = items.where(F.col("block") == block).select(F.col("item_id").cast("string"), "text").toArrow()
        return spark.sparkContext.broadcast(TestSet(rows["item_id"].to_pylist(), rows["text"].to_pylist(), width))

    def run(shared) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch.column(place), SHARD_BYTES):
                    own = batch.slice(part.first, part.rows)
                    yield pa.RecordBatch.from_arrays([*own.columns, *_document_columns(part, shared.value, matches)],
                                                     names=[*batch.schema.names, "n_words", "n_hit", "items", "matches", "hit_spans"])

        return docs.mapInArrow(work, ", ".join([*fields, ADDED]))

    # every block but the first is a pass of its own, written and done with before the next set is built
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    further = None
    for block in range(1, blocks):
        shared = shared_set(block)
        some = run(shared).where("n_hit > 0").select(key.alias("__dc_found"), F.col("doc_id").alias("__dc_id"), "items", "matches", "hit_spans").dropDuplicates(["__dc_found", "__dc_id"])
        written = staging.table(f"found-{block}", some)
        shared.destroy()
        further = written if further is None else further.unionByName(written)
    result = run(shared_set(0))
    staging.remove("items")
    if further is not None:
        result = _merged(result.withColumn("__dc_key", key), further)
    return (result.drop("hit_spans")
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def _merged(result: DataFrame, further: DataFrame) -> DataFrame:
    """The first block's findings with those of the others: only rows with findings are gathered, by id and text."""
    together = further.groupBy("__dc_found", "__dc_id").agg(
        F.flatten(F.collect_list("items")).alias("__dc_items"), F.flatten(F.collect_list("matches")).alias("__dc_matches"), F.flatten(F.collect_list("hit_spans")).alias("__dc_spans"))
    start = F.struct(F.lit(0).cast("long").alias("until"), F.lit(0).cast("long").alias("n"))
    spans = F.array_sort(F.concat("hit_spans", "__dc_spans"))
    covered = F.aggregate(spans, start, lambda s, x: F.struct(
        F.greatest(s["until"], x["until"]).alias("until"),
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["until"] - F.greatest(s["until"], x["begin"]))).alias("n")))["n"]
    wide = result.join(together, (F.col("__dc_key") == F.col("__dc_found")) & F.col("doc_id").eqNullSafe(F.col("__dc_id")), "left")
    more = F.col("__dc_found").isNotNull()
    return (wide.withColumn("n_hit", F.when(more, covered).otherwise(F.col("n_hit")))
            .withColumn("items", F.when(more, F.array_sort(F.array_distinct(F.concat("items", "__dc_items")))).otherwise(F.col("items")))
            .withColumn("matches", F.when(more & F.col("matches").isNotNull(), F.array_sort(F.concat("matches", "__dc_matches"))).otherwise(F.col("matches")))
            .drop("__dc_key", "__dc_found", "__dc_id", "__dc_items", "__dc_matches", "__dc_spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return find_matches(docs, benchmark, width, matches=False).where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns from ``find_matches``."""
    found = find_matches(docs.select("doc_id", "text"), benchmark, matches=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
g AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, iw.item_id FROM g JOIN iw ON g.n = iw.n AND g.g = iw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
