"""Secret scans: a random forest that removes false positives among candidate strings.

Candidates are: whatever is assigned to a credential name, of any length and characters; keys of known
formats; the lines of a private key's PEM body; and any other run of ``[A-Za-z0-9+/_=-]`` of at least ``SHORTEST``
characters, less a leading ``name=``, that holds a digit, or letters of both cases beyond a leading capital.  Its features are length and character make-up,
character transitions (class changes, and mean log-probability of its letter pairs), dictionary
coverage (share of its four-letter pieces that the corpus holds often enough, and their mean
log-probability), path (slashes, dots, the document's source) and neighbouring words and marks.  The forest is fitted
on the driver from at most about ``FIT_FINDINGS`` labelled findings' features and scores every
candidate of every text.

Pairs and pieces are counted over the words of all documents, in tables of ``PAIR_SLOTS`` and ``PIECE_SLOTS``
hashed slots, so what reaches the driver and the tasks is bounded at any size of the corpus and nothing is
left out; only the labelled findings are sampled.  A piece is held often enough from a share of all pieces on,
which means the same at every size.

``rule_findings`` supplies labels where no triaged findings exist: known formats, PEM bodies and what is
assigned to a credential name are secrets (but for placeholders and bare words); runs that are clearly words, paths or
plain numbers are not; all others stay unlabelled.  So that the forest does not learn the rule in place of the strings,
each secret among these labels counts a second time with the surroundings of one that is not.

Defined cases: a null or empty text has no candidates; a null source is a source of its own; offsets
count code points; with labels of one class every score is that class, without labels 0.5; rows that
repeat a ``doc_id`` are scanned each on its own; findings without a matching candidate are ignored; an
empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import thinned
from .staging import Staging, bounded_batches
from .trees import random_forest

SHORTEST = 16
FIT_FINDINGS = 20_000
PAIR_SLOTS, PIECE_SLOTS = 1 << 16, 1 << 18
# a piece is known from this part of an even share of the slots on
KNOWN = 1 / 64
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
MIXED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z][A-Z]+[a-z]")
# Names that credentials are assigned to.
NAMES = r"(?:token|secret|secret[_-]?key|passw(?:or)?d|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"
CREDENTIAL = re.compile(rf"(?i)(?:{NAMES}\W{{0,6}}|authorization\W{{1,6}}(?:bearer|basic|token)\s+)$")
ASSIGNED = re.compile(r"[=:]>?\s*[\"'`]?$")
NAMED = re.compile(rf"(?i)(?:{NAMES}[\"'`\])]{{0,3}}[ \t]*(?:=>|:=|==?|:)[ \t]*|authorization\W{{1,6}}(?:bearer|basic|token)[ \t]+)"
                   r"(?:([\"'`])((?:(?!\1)[^\n\\]|\\.)+)\1|[\"'`]?([^\s\"'`]+))")
NAME_PARTS = ("token", "secret", "passw", "pwd", "passphrase", "key", "credential", "auth")
#: what every text with a candidate matches, in Java's dialect too
HINT = RUN.pattern + r"|(?i:token|secret|passw|pwd|passphrase|(?:api|access|private)[_-]?key|credential|auth)[^a-zA-Z0-9]|PRIVATE KEY-----"
# Formats that issuers give their keys.
FORMATS = re.compile(r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
                     r"|sk-[A-Za-z0-9_-]*[A-Za-z0-9]{20,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
                     r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)(?![A-Za-z0-9])")
FORMAT_PARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "k_live_", "k_test_", "AIza", "npm_", "SG.", "eyJ")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(.*?)(?:-----END|\Z)", re.S)
PEM_LINE = re.compile(r"^[ \t]*([A-Za-z0-9+/]+=*)[ \t]*\r?$", re.M)
LEADING_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*=+(?=[^=])")
PLACEHOLDER = re.compile(r"(?i)[x*.•_-]+|<.*>|\$?\{.*\}|\$\w+|%.*%|none|null|true|false|your[ _-].*|[a-z]+")
FEATURES = ["length", "digits", "upper", "lower", "hex", "marks", "distinct", "entropy", "changes", "pairs", "covered", "pieces", "slashes", "dots_near",
            "source", "assigned", "quoted", "credential_word", "word_before", "word_after", "words_near", "format"]
# what the surroundings of a candidate decide
AROUND = [FEATURES.index(n) for n in ("dots_near", "assigned", "quoted", "credential_word", "word_before", "word_after", "words_near")]


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(text: str, n: int, slots: int) -> np.ndarray:
    """Slots of the ``n`` letters in a row of ``text``, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    count = len(codes) - n + 1
    if count < 1:
        return np.zeros(0, np.int64)
    letter = _letters()[codes]
    whole, mixed = letter[:count].copy(), codes[:count].copy()
    for k in range(1, n):
        whole &= letter[k : k + count]
        mixed = mixed * np.uint64(0x100000001B3) + codes[k : k + count]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed[whole] >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


class Dictionary:
    """Log-probabilities of letter pairs and four-letter pieces, by hashed slot."""

    def __init__(self, pairs: np.ndarray, pieces: np.ndarray):
        self.pairs = np.log((pairs + 0.5) / (pairs.sum() + 1)).astype(np.float32)
        self.pieces = np.log((pieces + 0.5) / (pieces.sum() + 1)).astype(np.float32)
        self.known = (pieces > 0) & (pieces * (len(pieces) / KNOWN) >= pieces.sum())
        self.floors = float(self.pairs.min()), float(self.pieces.min())

    def of(self, run: str) -> tuple[float, float, float]:
        """Mean log-probability of pairs, share of known pieces, mean log-probability of pieces; what is not of letters counts as unseen."""
        low = run.lower()
        two, four = _grams(low, 2, PAIR_SLOTS), _grams(low, 4, PIECE_SLOTS)
        n, m = max(len(low) - 1, 1), max(len(low) - 3, 1)
        return ((float(self.pairs[two].sum()) + (n - len(two)) * self.floors[0]) / n, int(self.known[four].sum()) / m,
                (float(self.pieces[four].sum()) + (m - len(four)) * self.floors[1]) / m)


def fit_dictionary(docs: DataFrame) -> Dictionary:
    """From the texts of all documents; slots ``PAIR_SLOTS`` and up are those of the pieces."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIR_SLOTS + PIECE_SLOTS, np.int64)
        for batch in batches:
            # joined, so that short texts do not cost a call each; the mark between them is no letter
            low, at = "\n".join(t for t in batch.column(0).to_pylist() if t).lower(), 0
            while at < len(low):  # a piece that begins in a part ends at most three letters after it
                total[:PAIR_SLOTS] += np.bincount(_grams(low[at : at + (1 << 20) + 1], 2, PAIR_SLOTS), minlength=PAIR_SLOTS)
                total[PAIR_SLOTS:] += np.bincount(_grams(low[at : at + (1 << 20) + 3], 4, PIECE_SLOTS), minlength=PIECE_SLOTS)
                at += 1 << 20
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(total[slots], pa.int64())], names=["slot", "n"])

    counts = docs.select("text").where("text IS NOT NULL").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # bounded by the slots
    total = np.zeros(PAIR_SLOTS + PIECE_SLOTS, np.int64)
    total[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return Dictionary(total[:PAIR_SLOTS], total[PAIR_SLOTS:])


def _named(text: str) -> Iterator[tuple[int, int, int | None]]:
    """What credential names are given; a placeholder, or a bare word, has no label."""
    at = 0
    while m := NAMED.search(text, at):
        begin, until = m.span(2) if m.group(1) else m.span(3)
        if not m.group(1):
            name = m.start()
            while name and (text[name - 1].isalnum() or text[name - 1] in "_-"):
                name -= 1
            if name and text[name - 1] in "?&" and (cut := re.search(r"[&#]", text[begin:until])):  # an address' argument
                until = max(begin + cut.start(), begin + 1)
            while until - begin > 1 and (text[until - 1] in ",;." or text[until - 1] in ")]}>" and text[begin:until].count(text[until - 1]) > text[begin:until].count("([{<"[")]}>".index(text[until - 1])])):
                until -= 1
        yield begin, until, None if PLACEHOLDER.fullmatch(text, begin, until) and not (m.group(1) and text[begin:until].isalpha()) else 1
        at = until


def spans(text: str) -> list[tuple[int, int, int | None]]:
    """Candidates ``(begin, until, label)`` in text order, none within another; runs have no label yet."""
    low, sure = text.lower(), []
    if any(p in low for p in NAME_PARTS):
        sure += _named(text)
    if any(p in text for p in FORMAT_PARTS):
        sure += [(*m.span(), 1) for m in FORMATS.finditer(text)]
    if "PRIVATE KEY-----" in text:
        sure += [(b.start(1) + line.start(1), b.start(1) + line.end(1), 1) for b in PEM.finditer(text) for line in PEM_LINE.finditer(b.group(1))]
    out, last = [], 0
    for begin, until, y in sorted(sure, key=lambda r: (r[0], -r[1], r[2] is None)):
        if begin >= last:
            out.append((begin, until, y))
            last = until
        elif y and out[-1][2] is None and until <= last:  # a key inside a longer placeholder
            out[-1] = (out[-1][0], last, 1)
    held, k = out[:], 0
    for m in RUN.finditer(text):
        begin = m.start()
        while k < len(held) and held[k][1] <= begin:
            k += 1
        cuts, j = [], k
        while j < len(held) and held[j][0] < m.end():  # what is left of the run around others
            cuts.append((begin, held[j][0]))
            begin, j = max(begin, held[j][1]), j + 1
        for a, b in [*cuts, (begin, m.end())]:
            while name := LEADING_NAME.match(text, a, b):
                a = name.end()
            if b - a >= SHORTEST and (MIXED.search(text, a + 1, b) or text[a].isdigit()):
                out.append((a, b, None))
    return sorted(out, key=lambda r: r[:2])


def candidates(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _ in spans(text)]


def features(text: str, begin: int, until: int, source: str | None, words: Dictionary) -> list[float]:
    run, before, after = text[begin:until], text[max(begin - 48, 0) : begin], text[until : until + 48]
    n = len(run)
    count = Counter(run)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in run]
    pair, covered, piece = words.of(run)
    left, right = re.findall(r"\w+", before), re.findall(r"\w+", after)
    hashed = lambda w: zlib.crc32(w.lower().encode()) % 64 if w else -1
    return [n, kind.count("d") / n, kind.count("u") / n, kind.count("l") / n, sum(c in "0123456789abcdefABCDEF" for c in run) / n, kind.count("m") / n,
            len(count) / n, -sum(v / n * math.log2(v / n) for v in count.values()), sum(a != b for a, b in zip(kind, kind[1:])) / n, pair, covered, piece,
            run.count("/"), before[-8:].count(".") + after[:8].count("."), hashed(source or ""), bool(ASSIGNED.search(before)),
            before[-1:] in "\"'`" and before != "", bool(CREDENTIAL.search(before)), hashed(left[-1] if left else ""), hashed(right[0] if right else ""), len(left) + len(right), bool(FORMATS.fullmatch(run))]


def plain(run: str, words: Dictionary) -> bool:
    """Clearly words, a path of words, or a plain number."""
    if re.fullmatch(r"[0-9_/+=-]+", run):
        return True
    parts = re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}", run)
    letters = sum(map(len, parts))
    return letters >= 0.75 * sum(c.isalnum() for c in run) and letters >= 4 * len(parts) and words.of(run)[1] >= 0.5


def rule_label(text: str, begin: int, until: int, label: int | None, words: Dictionary) -> int | None:
    """``label`` is what ``spans`` knows of the candidate."""
    if label is not None or CREDENTIAL.search(text[max(begin - 48, 0) : begin]):
        return label
    return 0 if plain(text[begin:until], words) else None


def _found(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.where(F.col("text").rlike(HINT))


def _featured(docs: DataFrame, words: Dictionary) -> DataFrame:
    """Every candidate's features, and its label by rule, from one scan of the texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, begins, untils, xs, ys = [], [], [], [], []
            for doc, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                for a, b, known in spans(text):
                    doc_ids.append(doc)
                    begins.append(a)
                    untils.append(b)
                    xs.append([float(v) for v in features(text, a, b, source, words)])
                    ys.append(rule_label(text, a, b, known, words))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(untils, pa.int64()), pa.array(xs, pa.list_(pa.float64())),
                                              pa.array(ys, pa.float64())], names=["doc_id", "begin", "until", "x", "ruled"])

    return _found(docs).mapInArrow(work, "doc_id long, begin long, until long, x array<double>, ruled double")


def rule_findings(found: DataFrame) -> DataFrame:
    """``(doc_id, begin, y)`` of the candidates that have a label by rule."""
    return found.where("ruled IS NOT NULL").select("doc_id", "begin", F.col("ruled").alias("y"))


def secret_findings(docs: DataFrame, findings: DataFrame | None = None, fit_findings: int = FIT_FINDINGS) -> DataFrame:
    """``(doc_id, begin, until, score, secret)`` for every candidate; ``findings`` ``(doc_id, begin, y)`` are labels."""
    words, staging = fit_dictionary(docs), Staging(docs.sparkSession, "secrets")
    by_rule = findings is None
    found = staging.table("found", _featured(docs, words))
    findings = rule_findings(found) if by_rule else findings
    # half of each label, so that the rarer one is not thinned with the other
    halves = [thinned(findings.where(F.col("y") == y), F.struct("doc_id", "begin"), fit_findings // 2, "findings") for y in (0, 1)]
    known = halves[0].unionByName(halves[1])
    known = known.groupBy("doc_id", "begin").agg(F.max(F.col("y").cast("double")).alias("y"))
    rows = found.join(F.broadcast(known), ["doc_id", "begin"]).select("doc_id", "begin", "y", "x").toArrow()  # bounded by the sample
    forest = None
    if rows.num_rows:
        y = rows.column("y").to_numpy()
        x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        order = np.lexsort((*x.T[::-1], y, rows.column("begin").to_numpy(), rows.column("doc_id").to_numpy()))
        x, y = x[order], y[order]
        if by_rule and 0 < y.sum() < len(y):
            again, others = x[y == 1], x[y == 0]
            again[:, AROUND] = others[np.arange(len(again)) * 7919 % len(others)][:, AROUND]
            x, y = np.concatenate([x, again]), np.concatenate([y, np.ones(len(again))])
        forest = random_forest(x, y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            share = np.clip(forest.sums(x), 0, 1) if forest is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(share)], names=["doc_id", "begin", "until", "score"])

    return found.drop("ruled").mapInArrow(score, "doc_id long, begin long, until long, score double").withColumn("secret", F.col("score") >= 0.5)
