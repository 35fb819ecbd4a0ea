"""Filter interaction audit: what each filter of a set removes, by itself, by its place in an order, and fairly shared.

Documents are counted once, per part and set of failed filters; all else follows from the 32
coalitions of five filters.  ``removed[S]`` is what the filters of a coalition S remove
together, found by adding up the counts of the sets that meet S.  The Hart-Mas-Colell potential of the game is
``P(S) = (removed[S] + sum of P(S - i)) / |S|``; a filter's Shapley value is ``P(all) - P(all - i)``.
Potentials are kept as whole numbers, ``|S|! * P(S)``, so the value summed over all orders is exact.
The steps of an order are differences of coalitions: a filter after the filters B removes ``removed[B + i] - removed[B]``.

``audit`` takes any table with a column of failed-filter bits; ``text_failures`` makes it for the five
text filters.  All of it is DataFrame functions.  Counts shuffle one row per task, part and set;
the copy filter shuffles a few numbers per document, by text digest and id together, so that a
text that a third of all rows share is spread over tasks, and counted there before it meets its own copies.

Defined cases: a null or empty text has no words and fails A alone (and E as a copy); a null part is the
empty string; a null ``doc_id`` is smaller than none and has no smaller one, so its row is never a copy nor
makes one; rows that repeat the smallest ``doc_id`` of a text are none of them copies; an id labelled
0 and 1 counts as 1, a missing or null label as 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
# The filters' thresholds and symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 100, 80, 10, r"[#$%&*|]"


def text_counts(pieces: Column, text: Column) -> dict[str, Column]:
    """Words, distinct words, capitals and code points of a text that is not null, and of its split at blanks.

    A blank at either end leaves one empty piece, and so does an empty text.  (``regexp_replace`` is
    slow here: its loop makes the generated method too long to compile.)"""
    head, tail = F.get(pieces, F.lit(0)) == "", (F.size(pieces) > 1) & (F.get(pieces, F.size(pieces) - 1) == "")
    return {"n_words": F.size(pieces) - head.cast("int") - tail.cast("int"), "n_distinct": F.size(F.array_distinct(pieces)) - (head | tail).cast("int"),
            "n_upper": F.regexp_count(text, F.lit("[A-Z]")), "n_chars": F.char_length(text), "symbol": text.rlike(SYMBOLS)}


def failed_bits() -> Column:
    """Bits of the filters A to D that a text of these counts fails."""
    n = {c: F.col(c).cast("long") for c in ("n_words", "n_distinct", "n_upper", "n_chars")}
    return (F.when(n["n_words"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * n["n_distinct"] < LEAST_DISTINCT * n["n_words"], 2).otherwise(0)
            + F.when(100 * n["n_upper"] > MOST_UPPER * n["n_chars"], 4).otherwise(0) + F.when(F.col("symbol"), 8).otherwise(0))


def text_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, failed, good, toxic, n)``: documents counted by lang, bits of the failed filters, and labels."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.split(text, BLANK).alias("pieces"))
    counted = texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                           *[c.alias(name) for name, c in text_counts(F.col("pieces"), F.col("text")).items()])
    base = counted.select("doc_id", "part", "digest", failed_bits().alias("failed"))
    known = (labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
             .groupBy(F.col("doc_id").alias("labelled"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    named = base.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "digest", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    marked = named.join(known, F.col("doc_id") == F.col("labelled"), "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    # per text, part and labels: the rows, and those of the smallest id among them
    kinds = (marked.groupBy("digest", "part", "failed", "good", "toxic")
             .agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first")))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(F.lit(0))
    copies = kinds.select("part", "failed", "good", "toxic", "n", firsts.alias("firsts"))
    sets = copies.select("part", "good", "toxic", F.explode(F.array(
        F.struct("failed", F.col("firsts").alias("n")),
        F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("firsts")).alias("n")))).alias("of"))
    nameless = base.where(F.col("doc_id").isNull()).select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.struct("failed", F.lit(1).cast("long").alias("n")).alias("of"))
    return (sets.unionByName(nameless).select("part", "good", "toxic", "of.failed", "of.n").where("n > 0")
            .groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n")))


def coalitions(failures: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part: ``n``, and arrays over all coalitions (index = bits) of removed rows, good and toxic ones; ``only`` and ``fails`` per filter; ``potential``."""
    k = len(filters)
    every = range(1 << k)
    of = lambda amount, met: F.coalesce(F.sum(F.when(met, amount)), F.lit(0))
    meets = lambda s: F.col("failed").bitwiseAND(s) != 0
    n = F.col("n")
    per = failures.groupBy("part").agg(
        F.sum("n").alias("n"),
        F.array(*[of(n, meets(s)) for s in every]).alias("removed"),
        F.array(*[of(n, meets(s) & F.col("good")) for s in every]).alias("good"),
        F.array(*[of(n, meets(s) & F.col("toxic")) for s in every]).alias("toxic"),
        F.array(*[of(n, F.col("failed") == 1 << i) for i in range(k)]).alias("only"),
        F.array(*[of(n, meets(1 << i)) for i in range(k)]).alias("fails"))
    # potentials by coalition size: |S|! P(S) = (|S|-1)! removed[S] + the same of S less each of its filters
    per = per.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, k + 1):
        of_size = [s for s in every if s.bit_count() == size]
        per = per.withColumns({f"p{s}": factorial(size - 1) * F.get("removed", F.lit(s)) + sum((F.col(f"p{s ^ 1 << i}") for i in range(k) if s >> i & 1), F.lit(0))
                               for s in of_size})
    return per.select("part", "n", "removed", "good", "toxic", "only", "fails", F.array(*[F.col(f"p{s}") for s in every]).alias("potential"))


def audit(failures: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``(part, failed, good, toxic, n)``.

    ``shapley`` is the filter's value times the number of orders: what it removes, summed over all of them."""
    k, full = len(filters), (1 << len(filters)) - 1
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(filters)]))
    steps = coalitions(failures, filters).withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    letter = F.expr("substring(filter_order, step, 1)")
    at = F.expr(f"locate(substring(filter_order, step, 1), '{filters}') - 1")
    before = F.expr(f"aggregate(sequence(1, step), 0, (bits, j) -> bits | if(j < step, shiftleft(1, locate(substring(filter_order, j, 1), '{filters}') - 1), 0))")
    steps = steps.withColumns({"filter": letter, "at": at, "before": before}).withColumn("after", F.col("before").bitwiseOR(F.expr("shiftleft(1, at)")))
    gained = lambda name: F.get(name, F.col("after")) - F.get(name, F.col("before"))
    without = F.lit(full) - F.expr("shiftleft(1, at)")
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "filter",
        (F.col("n") - F.get("removed", F.col("after"))).alias("kept"), gained("removed").alias("removed"),
        (F.get("fails", F.col("at")) - gained("removed")).alias("redundant"), F.get("only", F.col("at")).alias("unique_fails"),
        gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(full)) - k * F.get("potential", without)).alias("shapley"))


def filter_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns from ``audit``."""
    return audit(text_failures(docs, labels)).drop("filter")


# Every document at every step of every order, one by one.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t),
              'D': regexp_matches(w.t, '[#$%&*|]'), 'E': coalesce(m.least < w.doc_id, false)} AS s
      FROM w JOIN m USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, s.A AS a, s.B AS b, s.C AS c, s.D AS d, s.E AS e, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT x1.x || x2.x || x3.x || x4.x || x5.x AS filter_order FROM x x1, x x2, x x3, x x4, x x5
      WHERE len(list_distinct([x1.x, x2.x, x3.x, x4.x, x5.x])) = 5),
s AS (SELECT g.*, filter_order, step, filter_order[step] AS letter,
             concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails,
             translate(filter_order[1:step - 1], fails, '') <> filter_order[1:step - 1] AS gone
      FROM g, o, (SELECT unnest(range(1, 6))::INTEGER AS step) t),
r AS (SELECT part, filter_order, step, letter,
             sum(CASE WHEN NOT gone AND NOT contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN NOT gone AND contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN gone AND contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN good AND NOT gone AND contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN toxic AND NOT gone AND contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
