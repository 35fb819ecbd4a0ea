"""Vectorised word and shingle hashing over Arrow string columns.

All operators that run numpy inside tasks start here.  A column's UTF-8 bytes are cut into
slices of whole texts (about ``SLICE_BYTES`` each; a longer text is a slice of its own), so a
task's memory follows its longest text and never the batch.  Word classes are byte classes:
every class used here keeps all bytes from 0x80 up, so a test per byte is a test per code point.

Empty and null texts have no words.  Hashes are 64-bit: a random value per byte value, summed
with powers of an odd multiplier, then mixed; the same text has the same hash in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

# Word characters as the byte classes [^\x20\x09-\x0D] and [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so its powers have inverses modulo 2^64
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240817)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_BYTE_VALUES_LOWER = _BYTE_VALUES[_LOWER]


class _Powers:
    """Powers of the base and of its inverse, grown as needed; tasks make their own."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __getstate__(self):
        return {"up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}

    def table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 64)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Whole texts of one column: ``data`` bytes, ``bounds`` (rows + 1 byte offsets), ``first`` row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first, self.rows = data, bounds, first, len(bounds) - 1

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def words(self, is_word: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the maximal runs of word bytes; a run never spans two texts."""
        inside = is_word[self.data]
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = self.bounds[(self.bounds > 0) & (self.bounds < n)]
        before[edges] = False
        after[edges - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash per byte range; empty ranges hash alike."""
        up, down = _powers.table(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((_BYTE_VALUES_LOWER if lower else _BYTE_VALUES)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's texts, in order, as slices of at most ``limit`` bytes (or one longer text)."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield Slice(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def runs_of(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Bounds (n_rows + 1) of each row's run in an ascending row index."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def windows(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every ``width``-word window inside one row (rolling over the flat word array)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * _BASE % (1 << 64)
        total += words[k : k + n] * np.uint64(factor)
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(total[at] + np.uint64(width)), at


def shingle_sets(part: Slice, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingle hashes of each text, ascending inside a row, and their rows.

    A text of fewer words, but not none, has its whole word sequence as one shingle."""
    starts, ends = part.words(SPACE_WORD)
    words, rows = part.hashes(starts, ends, lower), part.row_of(starts)
    hashes, at = windows(words, rows, width)
    owner = rows[at]
    bounds = runs_of(rows, part.rows)
    count = np.diff(bounds)
    for k in range(1, width):  # one shingle per short text
        short = np.flatnonzero(count == k)
        if len(short):
            total = np.zeros(len(short), dtype=np.uint64)
            for j in range(k):
                total = mix(total + words[bounds[short] + j] * _MULT)
            hashes, owner = np.concatenate([hashes, mix(total + np.uint64(k))]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]
