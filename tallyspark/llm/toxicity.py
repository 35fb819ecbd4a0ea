"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows (at most about ``FIT_POSITIVE``, outside the held-out fold) stand against a
sample of all documents' texts, labels unseen (at most about ``FIT_UNLABELLED``).  A text is the set
of its hashed words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased) and of the words' first 4 to 10
bytes.  Those that are clearly more or less frequent among the confirmed rows become the inputs, scaled by their log frequency ratio; a
linear classifier is fitted in numpy by gradient steps on the non-negative risk of Kiryo et al. 2017,

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),

with the sigmoid loss; where the bracket falls below zero, the step goes up its gradient instead.
The prior is the toxic share of the usable labels (those outside the held-out fold).  The unlabelled sample is drawn from all documents, held-out ones
included, as their texts without labels: no held-out label is seen.  Features are collected as word hashes, never
texts; scoring is one pass over the documents.

Defined cases: a null or empty text has no words and gets the constant's score; without confirmed
rows every score is 0 (below 1e-9); an id that is labelled 0 and 1 counts as 1; a label without its document is ignored;
rows that repeat a ``doc_id`` are scored each on its own; a null ``doc_id`` belongs to the fold of the
empty text; an empty table gives an empty result; extra columns stay (``held_out score predicted``
are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, labelled_ids, texts_of, thinned
from .staging import bounded_batches
from .tokens import ALNUM_WORD, Slice, mix, runs_of, slices

FIT_POSITIVE, FIT_UNLABELLED = 4_000, 6_000
FOLDS, HELD = 5, 0
PREFIXES = (4, 5, 6, 7, 8, 10)
STEPS, RATE, SHRINK, MIN_Z, MIN_TEXTS = 400, 0.05, 1e-4, 5.0, 5


def word_sets(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct inputs of each text (32-bit hashes of words and of their beginnings), and bounds of each text's run."""
    starts, ends = part.words(ALNUM_WORD)
    row = part.row_of(starts)
    found = [(row << 32) | (part.hashes(starts, ends, lower=True) >> np.uint64(32)).astype(np.int64)]
    for k in PREFIXES:
        longer = ends - starts > k
        hashes = mix(part.hashes(starts[longer], starts[longer] + k, lower=True) + np.uint64(k))
        found.append((row[longer] << 32) | (hashes >> np.uint64(32)).astype(np.int64))
    flat = np.unique(np.concatenate(found))
    return (flat & 0xFFFFFFFF).astype(np.uint32), runs_of(flat >> 32, part.rows)


class ToxicityModel:
    """The inputs that count (ascending hashes) with their weights, and the constant."""

    def __init__(self, used: np.ndarray, weights: np.ndarray, constant: float):
        self.used, self.weights, self.constant = used, weights, constant

    def scores(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(self.used):
            return np.full(len(bounds) - 1, _sigmoid(np.array(self.constant)))
        at = np.minimum(np.searchsorted(self.used, words), len(self.used) - 1)
        gained = np.concatenate([[0.0], np.cumsum(np.where(self.used[at] == words, self.weights[at], 0.0))])
        return _sigmoid(self.constant + gained[bounds[1:]] - gained[bounds[:-1]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> ToxicityModel:
    """Weights from word sets of confirmed and unlabelled texts."""
    n_p, n_u = len(positive), len(unlabelled)
    none = np.zeros(0, np.uint32)
    seen, count_p = np.unique(np.concatenate(positive), return_counts=True)
    seen_u, many_u = np.unique(np.concatenate([*unlabelled, none]), return_counts=True)
    known = np.union1d(seen[count_p >= MIN_TEXTS], seen_u[many_u >= MIN_TEXTS])

    def counted(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(values, known), max(len(values) - 1, 0))
        return np.where(values[at] == known, counts[at], 0).astype(float) if len(values) else np.zeros(len(known))

    count_p, count_u = counted(seen, count_p), counted(seen_u, many_u)
    share = (count_p + count_u) / (n_p + n_u)
    z = (count_p / n_p - count_u / max(n_u, 1)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / max(n_u, 1)))
    clear = np.abs(z) >= MIN_Z
    used = known[clear]
    ratio = np.log((count_p[clear] + 0.5) / (n_p + 1)) - np.log((count_u[clear] + 0.5) / (n_u + 1))

    def table(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate([*sets, none])
        if not len(used):
            return row[:0], row[:0]
        col = np.minimum(np.searchsorted(used, flat), len(used) - 1)
        hit = used[col] == flat
        return row[hit], col[hit]

    (p_row, p_col), (u_row, u_col) = table(positive), table(unlabelled)
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        scaled = w * ratio
        f_p = b + np.bincount(p_row, scaled[p_col], n_p)
        f_u = b + np.bincount(u_row, scaled[u_col], n_u)
        s_p, s_u = _sigmoid(f_p), _sigmoid(f_u)  # sigmoid loss: l(f) = 1 - s, l(-f) = s
        slope_p, slope_u = s_p * (1 - s_p) / n_p, s_u * (1 - s_u) / max(n_u, 1)
        negative = s_u.mean() - prior * s_p.mean() if n_u else 0.0
        if negative >= 0:
            g_p, g_u = -2 * prior * slope_p, slope_u
        else:
            g_p, g_u = prior * slope_p, -slope_u
        gradient = np.append((np.bincount(p_col, g_p[p_row], len(used)) + np.bincount(u_col, g_u[u_row], len(used))) * ratio + SHRINK * w, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return ToxicityModel(used, w * ratio, float(b))


def _word_rows(texts: DataFrame) -> pa.Table:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                words, bounds = word_sets(part)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.rows).columns[:2], lists], names=["id", "y", "words"])

    return texts.mapInArrow(work, "id long, y double, words array<int>").toArrow()


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_positive: int = FIT_POSITIVE, fit_unlabelled: int = FIT_UNLABELLED) -> ToxicityModel:
    """Fitted from bounded samples; the prior comes from the labels outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    usable = labelled_ids(labels, "toxic", FOLDS, HELD)
    prior = usable.agg(F.avg("y")).first()[0] or 0.0
    confirmed = thinned(usable.where("y = 1"), F.col("id"), fit_positive, "toxic")
    positive = _word_rows(texts_of(docs, confirmed))
    if not positive.num_rows or not prior:
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(0), -1000.0)
    others = thinned(docs.select(F.col("doc_id").alias("id"), F.lit(0.0).alias("y"), "text"), F.struct("id", F.xxhash64("text")), fit_unlabelled, "unlabelled")

    def sets(rows: pa.Table) -> list[np.ndarray]:
        found = {x.values.to_numpy(zero_copy_only=False).view(np.uint32).tobytes() for x in rows.column("words")}
        return [np.frombuffer(b, np.uint32) for b in sorted(found)]  # copies count once, in one order

    return fit_nnpu(sets(positive), sets(_word_rows(others)), float(prior))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    place = docs.columns.index("text")
    schema = [*[f"`{c.replace('`', '``')}` {t}" for c, t in docs.dtypes], "score double"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(place)):
                score = pa.array(model.scores(*word_sets(part)))
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.rows).columns, score], names=[*batch.schema.names, "score"])

    return (docs.mapInArrow(work, ", ".join(schema)).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select("doc_id", "held_out", "score", "predicted")
