"""Quality rules from repetition coverage.

Words are ``[^\\x20\\x09-\\x0D]+``.  For several n-gram lengths, rolling hashes over the words find the
windows that a text holds twice or more, and the characters (code points in words) that lie in them:

* 2, 3 and 4 words: the largest share that all occurrences of one repeated n-gram make up;
* 5 to 10 words: the share of characters inside any repeated n-gram, first occurrence included
  (a window can only repeat where the shorter one does, so each length searches what the last found);
* lines with a word that equal an earlier line: their share of the lines and of the characters.

A document is kept if it passes the base rules (50 words or more, at most half of them in repeated
3-word windows) and stays within every limit of ``LIMITS``.

Defined cases: a null or empty text has no words, fails the base rules and has all shares 0; rows
that repeat a ``doc_id`` are judged each on its own; nulls in other columns change nothing; an empty
table gives an empty result; extra columns stay (the added names are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_batches
from .tokens import SPACE_WORD, Slice, mix, slices, windows

MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
# The repetition limits of the MassiveText rules (Rae et al. 2021, table A1).
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMITS = {"dup_line_share": 0.30, "dup_line_char_share": 0.20}
LIMITS = {**{f"top_{n}_share": v for n, v in TOP_LIMITS.items()}, **{f"dup_{n}_share": v for n, v in DUP_LIMITS.items()}, **LINE_LIMITS}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how many equal it, and whether an earlier one does not (ties keep their order)."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.cumsum(fresh) - 1
    count, first = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    count[order] = np.bincount(group)[group] if len(keys) else 0
    first[order] = fresh
    return count, first


def _covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge)[:-1] > 0


def repetition_stats(part: Slice) -> dict[str, np.ndarray]:
    """The base counts and all shares of one slice's texts."""
    n = part.rows
    starts, ends = part.words(SPACE_WORD)
    words, rows = part.hashes(starts, ends), part.row_of(starts)
    first = np.searchsorted(rows, np.arange(n + 1))
    code_points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    chars = code_points[ends] - code_points[starts]
    before = np.concatenate([[0], np.cumsum(chars)])
    total = before[first[1:]] - before[first[:-1]]
    part_of = np.maximum(total, 1)
    out = {"n_words": np.diff(first), "word_chars": total, "n_symbols": _per_row(SYMBOL[part.data], part.bounds)}
    salt = mix(rows.astype(np.uint64) + np.uint64(1))

    alive = None  # first words of the windows that repeat at the last length
    for width in range(2, 11):
        hashes, at = windows(words, rows, width)
        if alive is not None:
            near = alive[at]
            hashes, at = hashes[near], at[near]
        count, _ = _groups(hashes ^ salt[at])
        again = count > 1
        at, count = at[again], count[again]
        alive = np.zeros(len(words), bool)
        alive[at] = True
        if width in TOP_LIMITS:
            most = np.zeros(n, np.int64)
            np.maximum.at(most, rows[at], count * (before[at + width] - before[at]))
            out[f"top_{width}_share"] = np.minimum(most / part_of, 1.0)  # overlapping occurrences count each
        if width == 3 or width in DUP_LIMITS:
            inside = _covered(at, width, len(words))
            if width == 3:
                out["n_repeat_words"] = _per_row(inside, first)
            else:
                out[f"dup_{width}_share"] = _per_row(chars * inside, first) / part_of

    breaks = np.flatnonzero(part.data == 10)
    head = np.zeros(len(part.data) + 1, bool)
    head[breaks + 1] = True
    head[part.bounds[:-1]] = True
    begin = np.flatnonzero(head[:-1])
    row = part.row_of(begin)
    until = np.minimum(np.append(breaks, len(part.data))[np.searchsorted(breaks, begin)], part.bounds[1:][row])
    at, to = np.searchsorted(starts, begin), np.searchsorted(starts, until)
    worded = to > at
    begin, until, row, at, to = begin[worded], until[worded], row[worded], at[worded], to[worded]
    _, fresh = _groups(part.hashes(begin, until) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    lines = np.bincount(row, minlength=n)
    out["n_dup_lines"] = np.bincount(row[~fresh], minlength=n)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(lines, 1)
    out["dup_line_char_share"] = np.bincount(row[~fresh], weights=(before[to] - before[at])[~fresh], minlength=n) / part_of
    return out


def repetition_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, every share, ``base_failed`` and ``kept``."""
    bounded_batches(docs.sparkSession)
    added = [*COUNTS, *LIMITS]
    docs = docs.drop(*added, "base_failed", "kept")
    place = docs.columns.index("text")
    schema = [*[f"`{c.replace('`', '``')}` {t}" for c, t in docs.dtypes], *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in LIMITS]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(place)):
                stats = repetition_stats(part)
                columns = [pa.array(stats[c].astype(np.int64 if c in COUNTS else np.float64)) for c in added]
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.rows).columns, *columns], names=[*batch.schema.names, *added])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for name, limit in LIMITS.items():
        within = within & (F.col(name) <= limit)
    return docs.mapInArrow(work, ", ".join(schema)).withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def repetition_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns and every share."""
    return repetition_rules(docs.select("doc_id", "text")).drop("text")
