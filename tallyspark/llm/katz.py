"""Language-model scoring: a Katz backoff model of word pairs, counted and evaluated over blocks of documents.

``P(w | h) = d(r) r / c(h)`` for a pair seen ``r`` times in training, else ``alpha(h) P(w)``; ``P(w)``
discounts the words' own counts and leaves the rest to the unknown word.  ``d`` are Katz's Good-Turing
discounts up to ``K`` (fewer where the counts of counts do not give values in (0, 1]).  A context none of whose
counts is discounted divides by ``c(h) + 1`` instead, so something is always left for unseen words.
``alpha`` makes the probabilities of all words, the unknown one included, add up to 1 after every context.
A text is its words and one end; its first word follows a start that is never predicted itself.

Tables, each written to the shared folder: ``blocks`` (about ``BLOCK_BYTES`` of whole texts each, tokens as places in
the block's word list); ``vocabulary`` (a word's number and count, numbered by falling count, so that counts are a step function of
the number: its steps, at most about sqrt(2N), are all that is broadcast); ``counted`` (pairs with their counts, by
partition of the pair's hash); ``contexts`` (alpha per context).  A block sends each of its distinct pairs
once, and the answer is the pair's count in the same order, so the shuffles grow with the distinct pairs of the blocks and
a word or pair that a third of all tokens repeat counts once a block.  Pairs go by their first word, those of the
few first words that would fill a partition by both.  Words are counted as they are; inside a block, and to find their number,
they are told apart by 64-bit hashes.

Defined cases: a null or empty text is one end; a null ``doc_id`` belongs to the fold of the empty text;
rows that repeat a ``doc_id`` are texts of their own; without training texts every probability is 1 (score 0);
one very long text is a block of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import fold
from .staging import Staging, bounded_batches
from .tokens import SPACE_WORD, mix, slices

FOLDS, HELD = 7, 2
K = 5
BLOCK_BYTES = 7 << 20
PAIRS_PER_PARTITION = 800_000
END = "\n"  # no word holds a line break
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def discounts(counts: list[int], k: int = K) -> np.ndarray:
    """Katz's ``d(0..k')`` from the numbers of events seen 1, 2, ... times; ``k'`` is the largest for which all are in (0, 1]."""
    n = [0, *counts, *[0] * (k + 1)]
    for top in range(k, 0, -1):
        if all(n[1 : top + 2]):
            rest = (top + 1) * n[top + 1] / n[1]
            d = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if rest < 1 else 0.0 for r in range(1, top + 1)]
            if all(0 < x <= 1 for x in d) and d[0] < 1:
                return np.array([0.0, *d])
    return np.zeros(1)


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts times their discounts."""
    return r * np.where(r < len(d), d[np.minimum(r, len(d) - 1)], 1.0)


@dataclass
class Words:
    """The unigram model as steps over word numbers: from ``first[i]`` on, words are seen ``count[i]`` times."""

    first: np.ndarray
    count: np.ndarray
    size: int  # distinct words; also the number of the start
    tokens: int
    texts: int

    def __post_init__(self):
        d = discounts([int(self.width[self.count == r].sum()) for r in range(1, K + 2)])
        share = discounted(self.count, d)
        free = float(self.width @ (self.count - share))
        whole = self.tokens if free > 0 else self.tokens + 1
        self.prob = share / max(whole, 1)
        self.unknown = (free if free > 0 else 1.0) / max(whole, 1)

    @property
    def width(self) -> np.ndarray:
        return np.diff(np.append(self.first, self.size))

    def counts(self, number: np.ndarray) -> np.ndarray:
        """Training count of each word number; the start counts once a text, an unknown word (-1) never."""
        if not self.size:
            return np.zeros(len(number), np.int64)
        step = np.searchsorted(self.first, number, side="right") - 1
        return np.where(number < 0, 0, np.where(number >= self.size, self.texts, self.count[np.maximum(step, 0)]))

    def probs(self, number: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(number), self.unknown)
        step = np.searchsorted(self.first, number, side="right") - 1
        return np.where(number < 0, self.unknown, self.prob[np.maximum(step, 0)])


def _bytes(values: np.ndarray) -> bytes:
    """An array as compressed bytes: numbers are small or sorted, and most of what is stored or shuffled here."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).data.cast("B") if len(values) else b"")


def _array(data, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _block(texts: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Texts as a block: tokens per text, token places, the word list by falling count, and training counts.

    Words are hashed slice by slice, so that memory follows the slice and the tokens."""
    parts = []
    base = 0
    for part in slices(texts):
        starts, ends = part.words(SPACE_WORD)
        parts.append((part.hashes(starts, ends, lower=True), starts + base, ends - starts, part.row_of(starts) + part.first, part.data))
        base += len(part.data)
    hashes, starts, sizes, rows = (np.concatenate([p[i] for p in parts]) for i in range(4))
    data = np.concatenate([p[4] for p in parts])
    del parts
    _, example, place, seen = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-seen, kind="stable")
    new = np.empty(len(order), np.int32)
    new[order] = np.arange(len(order), dtype=np.int32)
    starts, size = starts[example[order]], sizes[example[order]]
    bounds = np.concatenate([[0], np.cumsum(size)])
    letters = _LOWER[data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)]]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())).cast(pa.string())
    length = np.bincount(rows, minlength=len(texts)) + 1
    tokens = np.full(len(hashes) + len(texts), len(size), np.int32)  # ends, but where a word stands
    tokens[np.arange(len(hashes)) + rows] = new[place.reshape(-1)]
    trained = np.bincount(tokens[np.repeat(~held, length)], minlength=len(size) + 1)
    return length.astype(np.int64), tokens, pa.concat_arrays([words, pa.array([END])]), trained


def _blocks(docs: DataFrame, held: Column) -> DataFrame:
    """``(block, doc_ids, held, n_tokens, length, tokens, words, trained)``; what only Python reads is the bytes of its array."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for batch in _gathered(batches, 2, BLOCK_BYTES):
            out = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            length, tokens, words, trained = _block(batch.column(2), out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), one(batch.column(0)), one(batch.column(1)), pa.array([len(tokens)], pa.int64()), pa.array([_bytes(length)]), pa.array([_bytes(tokens)]),
                 one(words), one(pa.array(trained, pa.int64()))], names=["block", "doc_ids", "held", "n_tokens", "length", "tokens", "words", "trained"])
            at += 1

    schema = f"block long, doc_ids array<{kind}>, held array<boolean>, n_tokens long, length binary, tokens binary, words array<string>, trained array<long>"
    return docs.select("doc_id", held.alias("held"), "text").mapInArrow(work, schema)


def _gathered(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches of a task joined until their texts reach ``size`` bytes."""
    held, have = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            have += batch.column(column).nbytes
        if have >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, have = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _number(blocks: DataFrame, staging: Staging) -> tuple[DataFrame, Words]:
    """``(word, number, count)``: words by falling count; and the unigram model."""
    spark = staging.spark
    seen = (blocks.select(F.explode(F.arrays_zip("words", "trained")).alias("w")).where("w.trained > 0")
            .groupBy(F.col("w.words").alias("word")).agg(F.sum("w.trained").alias("count")))
    counts = staging.table("words", seen)  # else the sort's sample would count twice
    placed = staging.table("vocabulary", counts.orderBy(F.desc("count"), "word").withColumn("place", F.monotonically_increasing_id()), compression="zstd")
    staging.remove("words")
    staging.settle()
    part = F.shiftright("place", 33)
    starts, before = [], 0
    for row in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row per shuffle partition
        starts.append((int(row.part), before))
        before += row.n
    offsets = spark.createDataFrame(starts, "part long, before long")
    numbered = (placed.join(F.broadcast(offsets), part == F.col("part"))
                .select("word", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("number"), "count"))
    steps = placed.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).toArrow()  # at most about sqrt(2 * tokens) rows
    count, width = steps["count"].to_numpy().astype(np.int64), steps["n"].to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(width)[:-1]]) if len(width) else np.zeros(0, np.int64)
    ends = placed.where(F.col("word") == END).select("count").first()
    return numbered, Words(first.astype(np.int64), count, int(width.sum()), int(count @ width), int(ends[0]) if ends else 0)


class _Pairs:
    """A block's distinct pairs of neighbours, in the order in which they are asked for and answered."""

    def __init__(self, row: dict, words: Words, partitions: int, spread: int):
        tokens, self.length = _list(row["tokens"], np.int32).astype(np.int64), _list(row["length"])
        n_local = int(tokens.max(initial=-1)) + 1
        number = np.full(n_local + 1, -1, np.int64)
        number[_list(row["place"])] = _list(row["number"])
        number[n_local] = words.size  # the start
        self.first = np.cumsum(self.length) - self.length
        prior = np.empty(len(tokens), np.int64)
        prior[1:] = tokens[:-1]
        prior[self.first] = n_local
        key, self.of = np.unique(prior * (n_local + 1) + tokens, return_inverse=True)
        self.of = self.of.reshape(-1)
        self.prior, self.word = key // (n_local + 1), key % (n_local + 1)
        self.h, self.w, self.number, self.tokens = number[self.prior], number[self.word], number, tokens
        known = np.flatnonzero((self.h >= 0) & (self.w >= 0))
        h, w = self.h[known], self.w[known]
        both = (h < spread) | (h == words.size)
        self.part = (mix(h.astype(np.uint64) * _ODD + np.where(both, w + 1, 0).astype(np.uint64)) % np.uint64(partitions)).astype(np.int64)
        order = np.lexsort((w, h, self.part))
        self.asked, self.part = known[order], self.part[order]
        self.bounds = np.searchsorted(self.part, np.arange(partitions + 1))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i] for name, column in zip(batch.schema.names, batch.columns)}


def _list(value: pa.Scalar, kind=np.int64) -> np.ndarray:
    """A list, or the bytes of an array, as an array; an absent one is empty."""
    if not value.is_valid:
        return np.zeros(0, kind)
    return _array(value.as_buffer(), kind) if pa.types.is_binary(value.type) else value.values.to_numpy(zero_copy_only=False)


def _sums_of(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, heads) if len(heads) else values[:0]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(fresh)


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row per block with the bytes of its columns: as many rows as the block has words are gathered."""
    kinds = [np.float64 if t == "double" else np.int64 for t in (dict(rows.dtypes)[c] for c in columns)]

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"][:1]} | {c: pa.array([_bytes(table[c].to_numpy().astype(kind))], pa.binary()) for c, kind in zip(columns, kinds)})

    return rows.select("block", *columns).groupBy("block").applyInArrow(pack, ", ".join(["block long", *[f"{c} binary" for c in columns]]))


def _requests(wide: DataFrame, words: Words, partitions: int, spread: int) -> DataFrame:
    """``(part, block, h, w, n)``: a block's pairs of known words for one partition, with their training counts."""
    shared = wide.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pairs = _Pairs(row, shared.value, partitions, spread)
            learned = np.repeat(~_list(row["held"]).astype(bool), pairs.length)
            n = np.bincount(pairs.of[learned], minlength=len(pairs.h))[pairs.asked]
            h, w = pairs.h[pairs.asked], pairs.w[pairs.asked]
            for p in np.flatnonzero(np.diff(pairs.bounds)).tolist():
                own = slice(pairs.bounds[p], pairs.bounds[p + 1])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([row["block"].as_py()], pa.int64()), *[pa.array([_bytes(x[own])]) for x in (h, w, n.astype(np.int64))]],
                                                 names=["part", "block", "h", "w", "n"])

    return wide.select("block", "held", "length", "tokens", "place", "number").mapInArrow(work, "part long, block long, h binary, w binary, n binary")


def _count(table: pa.Table) -> pa.Table:
    """One partition: every block's pairs answered with their counts over all blocks, and the pairs seen in training themselves."""
    asked = [[_array(x.as_buffer()) for x in table[c]] for c in ("h", "w", "n")]
    bounds = np.cumsum([0, *map(len, asked[0])])
    h, w, n = (np.concatenate(x) for x in asked)
    order = np.lexsort((w, h))
    h, w, n = h[order], w[order], n[order]
    heads = _heads(h, w)
    total = _sums_of(n, heads)
    answers = np.empty(len(h), np.int64)
    answers[order] = np.repeat(total, np.diff(np.append(heads, len(h))))
    seen = total > 0
    k, none = table.num_rows, [None] * table.num_rows
    few = np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3)
    return pa.table({
        "kind": pa.array(["answers"] * k + ["pairs"]), "part": pa.array([table["part"][0].as_py()] * (k + 1), pa.int64()), "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
        "h": pa.array([*none, _bytes(h[heads][seen])], pa.binary()), "w": pa.array([*none, _bytes(w[heads][seen])], pa.binary()),
        "r": pa.array([*[_bytes(answers[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], _bytes(total[seen])], pa.binary()),
        "few": pa.array([*none, few.tolist()], pa.list_(pa.int64()))})


def _contexts(pairs: DataFrame, words: Words, d: np.ndarray) -> DataFrame:
    """``(h, alpha, more)``: the backoff weight of each context, and what its divisor is raised by."""
    shared = pairs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for row in _rows(batches):
            h, w, r = _list(row["h"]), _list(row["w"]), _list(row["r"])
            heads = _heads(h)
            sums = [_sums_of(x, heads) for x in (r - discounted(r, d), model.probs(w), (r < len(d)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(h[heads], pa.int64()), pa.array(model.counts(h[heads]), pa.int64()), *[pa.array(x) for x in sums]],
                                             names=["h", "count", "free", "lower", "few"])

    partial = pairs.select("h", "w", "r").mapInArrow(work, "h long, count long, free double, lower double, few long")
    summed = partial.groupBy("h").agg(F.max("count").alias("count"), *[F.sum(c).alias(c) for c in ("free", "lower", "few")])
    mass = F.when(F.col("few") > 0, F.col("free") / F.col("count")).otherwise(1 / (F.col("count") + F.lit(1.0)))
    rest = F.greatest(1 - F.col("lower"), F.lit(float(words.unknown)))  # the unknown word follows no context in training
    return summed.select("h", (mass / rest).alias("alpha"), F.when(F.col("few") > 0, 0).otherwise(1).cast("long").alias("more"))


def _score(wide: DataFrame, kind: str, words: Words, d: np.ndarray, start: tuple[float, int], partitions: int, spread: int) -> DataFrame:
    """Every text's logarithms, added up inside its block."""
    shared = wide.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for row in _rows(batches):
            pairs = _Pairs(row, model, partitions, spread)
            alpha, more = np.ones(len(pairs.number)), np.zeros(len(pairs.number), np.int64)
            weight = _list(row["alpha"], np.float64)
            alpha[_list(row["place"])], more[_list(row["place"])] = np.abs(weight), weight < 0
            alpha[-1], more[-1] = start
            # a pair's own estimate where it was seen, else its context's weight times the estimate of the word alone
            logs = np.log10(model.probs(pairs.w)) + np.log10(alpha[pairs.prior])
            r = np.zeros(len(pairs.h), np.int64)
            for answer in row["answers"].values if row["answers"].is_valid else ():
                p = answer["part"].as_py()
                r[pairs.asked[pairs.bounds[p] : pairs.bounds[p + 1]]] = _list(answer["r"])
            seen = np.flatnonzero(r)
            logs[seen] = np.log10(discounted(r[seen], d) / (model.counts(pairs.h[seen]) + more[pairs.prior[seen]]))
            count = model.counts(pairs.number)[pairs.tokens]
            base = np.log10((count + 1) / (model.tokens + model.size + 1))
            n_known, base, score = (_sums_of(x, pairs.first) for x in ((count > 0).astype(np.int64), base, logs[pairs.of]))
            yield pa.RecordBatch.from_arrays([row["doc_ids"].values, row["held"].values, *map(pa.array, (pairs.length, n_known, base, score))],
                                             names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    names = ["doc_ids", "held", "length", "tokens", "place", "number", "alpha", "answers"]
    return wide.select(*names).mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


@dataclass
class Katz:
    """The model's tables, and the texts' scores by it."""

    vocabulary: DataFrame  # word, number, count
    pairs: DataFrame  # part, h, w, r: a partition's pairs and counts as bytes of int64 arrays (see ``pair_rows``)
    contexts: DataFrame  # h, alpha, more
    words: Words
    discounts: np.ndarray
    scores: DataFrame  # doc_id, held_out, n_tokens, n_known, base_score, score
    staging: Staging


def pair_rows(pairs: DataFrame) -> DataFrame:
    """``(h, w, r)``, a row per pair seen in training; words by number, the start by the vocabulary's size."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_list(row[c])) for c in ("h", "w", "r")], names=["h", "w", "r"])

    return pairs.select("h", "w", "r").mapInArrow(work, "h long, w long, r long")


def katz_scores(docs: DataFrame, held: Column | None = None, folds: int = FOLDS, held_fold: int = HELD) -> Katz:
    """Learns from the rows where ``held`` is false (by default those outside one fold of the ids) and scores all rows.

    The tables stay in the shared folder as long as the scores are needed; ``staging.remove()`` deletes them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    staging = Staging(spark, "katz")
    held = held if held is not None else fold(F.col("doc_id"), folds) == held_fold
    try:
        return _scored(docs, held, staging)
    finally:
        staging.forget()


def _scored(docs: DataFrame, held: Column, staging: Staging) -> Katz:
    spark = staging.spark
    # by bucket, so that the blocks' tokens stay where they are and only what is asked and answered is shuffled
    blocks = staging.bucketed("blocks", _blocks(docs, held), "block", int(spark.conf.get("spark.sql.shuffle.partitions")), compression="zstd")
    vocabulary, words = _number(blocks, staging)
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PAIRS_PER_PARTITION))
    # first words that would fill an eighth of a partition go by pairs: by falling count, those before ``spread``
    spread = int(np.append(words.first, words.size)[int(np.sum(words.count > words.tokens // (8 * partitions)))])
    code = F.xxhash64("word").alias("code")  # words meet their number by 64-bit hash, as inside a block
    numbers = staging.table("numbers", blocks.select("block", F.posexplode("words").alias("place", "word")).select("block", "place", code)
                            .join(vocabulary.select(code, "number"), "code").select("block", "place", "number"), compression="zstd")
    staging.settle()
    tokens = blocks.select("block", "doc_ids", "held", "length", "tokens")
    asking = tokens.join(_packed(numbers, ["place", "number"]), "block", "left")
    counted = staging.table("counted", _requests(asking, words, partitions, spread).groupBy("part").applyInArrow(
        _count, "kind string, part long, block long, h binary, w binary, r binary, few array<long>"), "kind")
    staging.settle()
    pairs = counted.where("kind = 'pairs'").select("part", "h", "w", "r")
    of_counts = counted.where("kind = 'pairs'").agg(*[F.sum(F.get("few", F.lit(r))) for r in range(1, K + 2)]).first()
    d = discounts([int(n or 0) for n in of_counts])
    contexts = staging.table("contexts", _contexts(pairs, words, d), compression="zstd")
    staging.settle()
    first = contexts.where(F.col("h") == words.size).first()
    # alpha is above 0; its sign tells whether the divisor is raised
    signed = F.coalesce(F.when(F.col("more") > 0, -F.col("alpha")).otherwise(F.col("alpha")), F.lit(1.0)).alias("alpha")
    weighed = numbers.join(contexts.select(F.col("h").alias("number"), "alpha", "more"), "number", "left").select("block", "place", "number", signed)
    weights = _packed(weighed, ["place", "number", "alpha"])
    answers = counted.where("kind = 'answers'").groupBy("block").agg(F.collect_list(F.struct("part", "r")).alias("answers"))
    wide = tokens.join(weights, "block", "left").join(answers, "block", "left")
    scores = staging.table("scores", _score(wide, dict(docs.dtypes)["doc_id"], words, d, (first.alpha, first.more) if first else (1.0, 0), partitions, spread))
    return Katz(vocabulary, pairs, contexts, words, d, scores, staging)


def katz_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from ``katz_scores``."""
    model = katz_scores(docs.select("doc_id", "text"))
    return model.scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
