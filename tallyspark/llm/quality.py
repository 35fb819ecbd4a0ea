"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text is reduced to ``FEATURES`` in numpy, inside the tasks: shares of character classes, word and
line shapes, repetition.  The trees are fitted on the driver from at most about ``FIT_ROWS`` labelled
rows' statistics (never texts) and travel to the tasks as flat arrays, which score whole batches.

Labels are learned only from rows outside the held-out fold; labels, lang, source and doc_id are no
inputs.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; without
usable labels every score is 0.5, with labels of one class it is near that class; an id that is
labelled 0 and 1 counts as 1; a label without its document is ignored; rows that repeat a ``doc_id``
are scored each on its own; a null ``doc_id`` belongs to the fold of the empty text; an empty table
gives an empty result; extra columns stay (``held_out score predicted`` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, labelled_ids, texts_of, thinned
from .staging import bounded_batches
from .repetition import _covered, _groups, _per_row
from .tokens import SPACE_WORD, Slice, mix, slices, windows

FIT_ROWS = 20_000
FOLDS, HELD = 3, 1

# Character classes by byte; every byte from 0x80 up is one class.
CLASSES = ["lower", "upper", "digit", "blank", "newline", "stop", "comma", "bang", "quote", "bracket", "pipe", "symbol", "other", "high"]
_MEMBERS = {"blank": b" \t\x0b\x0c\r", "newline": b"\n", "stop": b".?", "comma": b",;:", "bang": b"!", "quote": b"\"'`", "bracket": b"()[]{}", "pipe": b"|", "symbol": b"#*$%&<>@^~=+_\\/"}
CLASS_OF = np.full(256, CLASSES.index("other"))
CLASS_OF[0x61:0x7B], CLASS_OF[0x41:0x5B], CLASS_OF[0x30:0x3A], CLASS_OF[0x80:] = 0, 1, 2, CLASSES.index("high")
for _name, _bytes in _MEMBERS.items():
    CLASS_OF[list(_bytes)] = CLASSES.index(_name)
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FEATURES = [*CLASSES, "words", "word_length", "word_spread", "short_words", "letterless_words", "letter_ended_words", "distinct_words",
            "repeated_triples", "lines", "line_words", "stopped_lines", "repeated_lines"]


def statistics(part: Slice) -> np.ndarray:
    """The features of one slice's texts (texts x features)."""
    n = part.rows
    size = np.diff(part.bounds)
    row = np.repeat(np.arange(n), size)
    shares = np.bincount(row * len(CLASSES) + CLASS_OF[part.data], minlength=n * len(CLASSES)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    starts, ends = part.words(SPACE_WORD)
    words, rows = part.hashes(starts, ends, lower=True), part.row_of(starts)
    first = np.searchsorted(rows, np.arange(n + 1))
    count = np.diff(first)
    per = np.maximum(count, 1)
    length = ends - starts
    letters = np.concatenate([[0], np.cumsum(LETTER[part.data])])
    mean = np.bincount(rows, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(rows, length.astype(float) ** 2, n) / per - mean**2, 0))
    salt = mix(rows.astype(np.uint64) + np.uint64(1))
    _, fresh = _groups(words ^ salt)
    triples, at = windows(words, rows, 3)
    many, _ = _groups(triples ^ salt[at])
    repeated = _covered(at[many > 1], 3, len(words))
    # lines with a word
    breaks = np.flatnonzero(part.data == 10)
    head = np.zeros(len(part.data) + 1, bool)
    head[breaks + 1] = True
    head[part.bounds[:-1]] = True
    begin = np.flatnonzero(head[:-1])
    owner = part.row_of(begin)
    until = np.minimum(np.append(breaks, len(part.data))[np.searchsorted(breaks, begin)], part.bounds[1:][owner])
    low, high = np.searchsorted(starts, begin), np.searchsorted(starts, until)
    full = high > low
    begin, until, owner, last = begin[full], until[full], owner[full], high[full] - 1
    lines = np.bincount(owner, minlength=n)
    stopped = np.bincount(owner[CLASS_OF[part.data[ends[last] - 1]] == CLASSES.index("stop")], minlength=n)
    _, new = _groups(part.hashes(begin, until) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    per_line = np.maximum(lines, 1)
    return np.column_stack([
        shares, np.log1p(count), mean, spread, _per_row(length <= 3, first) / per, _per_row(letters[ends] == letters[starts], first) / per,
        _per_row(LETTER[part.data[ends - 1]], first) / per, _per_row(fresh, first) / per, _per_row(repeated, first) / per,
        np.log1p(lines), count / per_line, stopped / per_line, np.bincount(owner[~new], minlength=n) / per_line])


class QualityModel:
    def __init__(self, forest, start: float):
        self.forest, self.start = forest, start

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = self.start + (self.forest.sums(x) if self.forest is not None else 0)
        return np.broadcast_to(1 / (1 + np.exp(-margin)), (len(x),))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fitted from at most about ``fit_rows`` labelled rows outside the held-out fold."""
    from .trees import boost

    ids = thinned(labelled_ids(labels, "quality", FOLDS, HELD), F.col("id"), fit_rows, "quality")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                x = statistics(part)
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.rows).columns[:2], pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    bounded_batches(docs.sparkSession)
    rows = texts_of(docs, ids).mapInArrow(work, "id long, y double, x array<double>").toArrow()
    if not rows.num_rows:
        return QualityModel(None, 0.0)
    y = rows.column("y").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    order = np.lexsort((*x.T[::-1], y, rows.column("id").to_numpy()))  # the same sums on every run
    forest, start = boost(x[order], y[order])
    return QualityModel(forest, start)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    place = docs.columns.index("text")
    schema = [*[f"`{c.replace('`', '``')}` {t}" for c, t in docs.dtypes], "score double"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(place)):
                score = pa.array(model.scores(statistics(part)))
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.rows).columns, score], names=[*batch.schema.names, "score"])

    return (docs.mapInArrow(work, ", ".join(schema)).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", "held_out", "score", "predicted")
