"""Mixing sources to target weights along a low-discrepancy schedule (DataFrame functions only).

Slot ``i`` of the schedule has the golden-ratio point ``frac(i * phi)``; the source whose share of the
cumulative weights holds that point gets the slot, and the slot's rank among its source's slots
names the block it takes.  A source's documents, in the order of a seeded hash of their ids, are laid end to
end (twice, as nothing is taken more than two times) and cut into blocks of ``block_words`` words.
Ranks stop at the block that reaches the source's target, whose last block is cut to the word;
blocks that the points have not reached by the end of the schedule follow as its tail (the
points' discrepancy, a few blocks a source).  So every source takes its target, to the word.

``mix`` gives the mix as numbers, ``mixed_texts`` as texts: the blocks' words in schedule order.

Shares: all sources share ``share`` (1.5) of all words by weight; a target stops at twice its
source's words and the excess is shared again by weight until none is above.

Ranks and running sums never put a source into one task: slots are ranked within chunks of the
schedule and documents within hash ranges of a source, about ``RANGE_ROWS`` rows each, and one row
per chunk or range carries the offsets.  Points meet sources by an equi-join on bins of [0, 1).

Defined cases: a null or empty text has no words and is taken 0 times; a null source is a source,
last in order; rows that repeat a ``doc_id`` are documents of their own; a null ``doc_id`` is shuffled
like any other; rows that tie in id stand by size; a source without words has target 0; an empty table gives an empty result; extra
columns stay whatever they are called (names that start with ``__mx_`` or ``mix_`` are reserved).
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import Staging

RANGE_ROWS = 8192
ADDED = ("size", "source_size", "target", "taken", "n_slots", "first_slot", "slots_md5")
WORD = r"[^\x20\x09-\x0D]+"
# Fixed value: the golden ratio's fractional part, (sqrt(5) - 1) / 2.
getcontext().prec = 50
PHI = (Decimal(5).sqrt() - 1) / 2
_LOW = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``(source, weight)``: weights repeat over the sources in code-point order, null last.

    One row per source: the window's size is the number of sources, not of documents."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sources.select("source").distinct().withColumn("__mx_place", place)
    return listed.select("source", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__mx_place") % len(weights) + 1).cast("int")).alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``; one-row aggregates steer the reshare."""
    per = sizes.join(weights.withColumnRenamed("source", "__mx_source"), F.col("source").eqNullSafe(F.col("__mx_source"))).drop("__mx_source")
    cap = F.col("source_size") * most
    total = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    words, heavy, held = total, None, -1
    while True:
        open_ = F.lit(True) if heavy is None else cap * F.lit(float(heavy)) > F.col("weight") * F.lit(float(words))
        row = per.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, cap)).alias("s"),
                      F.sum((~open_).cast("long")).alias("n")).first()
        if row.n == held or row.w is None:
            break
        words, heavy, held = total - (row.s or 0), row.w, row.n
    if heavy is None:
        return per.withColumn("target", F.lit(0.0))
    fair = F.col("weight") * F.lit(float(words)) / F.lit(float(heavy))
    return per.withColumn("target", F.when(cap * F.lit(float(heavy)) > F.col("weight") * F.lit(float(words)), fair).otherwise(cap.cast("double")))


def _point(i: Column) -> Column:
    """frac(i * phi), with ``i`` split so that doubles keep about 1e-10 at any length of the schedule."""
    high, low = float((PHI * _LOW) % 1), float(PHI)
    p = F.floor(i / _LOW) * F.lit(high) + (i % _LOW) * F.lit(low)
    return p - F.floor(p)


def _offsets(frame: DataFrame, keys: list[str], part: str, amount: str, name: str) -> DataFrame:
    """Exclusive running sum of ``amount`` over the parts of each key."""
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0)))


def schedule(spark: SparkSession, shares: DataFrame, chunk: int = 1 << 12) -> DataFrame:
    """``(slot, source_no, rank)``: every block of every source once, in schedule order; tail slots come last.

    ``shares`` has ``source_no, quota`` (blocks to take); the weights are the quotas."""
    total, n = shares.agg(F.sum("quota"), F.count(F.lit(1))).first()
    total = int(total or 0)
    bins = max(1, 4 * n)
    whole = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)  # one row per source
    laid = shares.where("quota > 0").withColumn("__mx_hi", F.sum("quota").over(whole) / F.lit(float(max(total, 1))))
    laid = laid.withColumn("__mx_lo", F.coalesce(F.lag("__mx_hi").over(Window.orderBy("source_no")), F.lit(0.0)))
    laid = laid.withColumn("__mx_bin", F.explode(F.sequence(F.floor(F.col("__mx_lo") * bins), F.least(F.floor(F.col("__mx_hi") * bins), F.lit(bins - 1)))))
    slots = spark.range(total).select(F.col("id").alias("slot"), _point(F.col("id")).alias("__mx_p"))
    hits = (slots.withColumn("__mx_bin", F.least(F.floor(F.col("__mx_p") * bins), F.lit(bins - 1))).join(laid, "__mx_bin")
            .where((F.col("__mx_p") >= F.col("__mx_lo")) & ((F.col("__mx_p") < F.col("__mx_hi")) | ((F.col("__mx_hi") >= 1.0) & (F.col("__mx_p") >= 1.0))))
            .select("slot", "source_no", "quota", F.floor(F.col("slot") / chunk).alias("__mx_chunk")))
    counts = _offsets(hits.groupBy("source_no", "__mx_chunk").agg(F.count(F.lit(1)).alias("__mx_n")), ["source_no"], "__mx_chunk", "__mx_n", "__mx_before")
    ranked = hits.join(counts, ["source_no", "__mx_chunk"]).withColumn(
        "rank", F.col("__mx_before") + F.row_number().over(Window.partitionBy("source_no", "__mx_chunk").orderBy("slot")) - 1)
    reached = counts.groupBy("source_no").agg(F.sum("__mx_n").alias("__mx_got"))
    tail = (shares.join(reached, "source_no", "left").withColumn("__mx_got", F.coalesce("__mx_got", F.lit(0))).where("__mx_got < quota")
            .select("source_no", F.explode(F.sequence(F.col("__mx_got"), F.col("quota") - 1)).alias("rank"))
            .select((F.lit(total) + F.col("rank") * F.lit(n) + F.col("source_no")).alias("slot"), "source_no", "rank"))
    return ranked.where("rank < quota").select("slot", "source_no", "rank").unionByName(tail)


def mix(docs: DataFrame, weights: DataFrame | None = None, block_words: int = 256, share: float = 1.5, most: int = 2, seed: int = 17,
        keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables.

    ``documents``: the rows of ``docs`` with ``size, source_size, target, taken`` and, from the schedule, ``n_slots``
    (slots that take words of it), ``first_slot`` and ``slots_md5`` (of all their numbers, rising, comma-joined; null without slots); ``slots``: the
    schedule ``(slot, source_no, rank)``; ``pieces``: ``(source_no, rank, at, doc_id, begin, until,
    words)``, what each block holds: from its word ``at`` on the words ``begin`` to ``until`` of a document, and the
    columns ``keys`` of its row.  ``weights`` is ``(source, weight)``; by default 5, 2, 1 repeating."""
    spark = docs.sparkSession
    staging = Staging(spark, "mix")
    extra = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    clash = set(ADDED) & set(extra)
    sized = docs.select("doc_id", "source", *[F.col(f"`{c}`") for c in extra if c not in clash], word_count(F.col("text")).alias("size"),
                        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("__mx_h"))
    sized = staging.table("sized", sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__mx_rows"))
    numbered = totals.withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    per = targets(totals.select("source", "source_size"), weights if weights is not None else cycling_weights(totals), share, most)
    per = staging.table("sources", per.join(numbered.select(F.col("source").alias("__mx_s"), "source_no", "__mx_rows"), F.col("source").eqNullSafe(F.col("__mx_s"))).drop("__mx_s")
                        .withColumn("goal", F.least(F.round("target").cast("long"), F.col("source_size") * most))
                        .withColumn("quota", F.ceil(F.col("goal") / block_words).cast("long"))
                        .withColumn("__mx_parts", F.ceil(F.col("__mx_rows") / RANGE_ROWS)))
    # the shuffled stream of each source: offsets by hash range, then inside a range
    unit = F.conv(F.substring("__mx_h", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    laid = per.select(F.col("source").alias("__mx_s"), "source_size", "target", F.col("goal").alias("__mx_goal"), F.col("source_no").alias("__mx_no"), "__mx_parts")
    placed = sized.join(laid, F.col("source").eqNullSafe(F.col("__mx_s"))).drop("__mx_s").withColumn("__mx_part", F.floor(unit * F.col("__mx_parts")))
    ranges = _offsets(placed.groupBy("__mx_no", "__mx_part").agg(F.sum("size").alias("__mx_words")), ["__mx_no"], "__mx_part", "__mx_words", "__mx_base")
    inside = Window.partitionBy("__mx_no", "__mx_part").orderBy("__mx_h", "doc_id", "size")
    stream = (placed.join(ranges.drop("__mx_words"), ["__mx_no", "__mx_part"])
              .withColumn("__mx_row", F.row_number().over(inside))
              .withColumn("__mx_at", F.col("__mx_base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    stream = staging.table("stream", stream.select("doc_id", "source", *[F.col(f"`{c}`") for c in extra if c not in clash], "size", "source_size", "target", "__mx_goal", "__mx_no", "__mx_part", "__mx_row", "__mx_at"))
    staging.remove("sized")
    # each pass over the stream, cut into blocks; the last block ends at the goal
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    begin, end = F.col("__mx_at") + F.col("__mx_round") * F.col("source_size"), F.col("__mx_end")
    block = F.lit(block_words)
    pieces = (stream.where("size > 0").withColumn("__mx_round", rounds).withColumn("__mx_begin", begin)
              .withColumn("__mx_end", F.least(F.col("__mx_begin") + F.col("size"), F.col("__mx_goal"))).where(F.col("__mx_begin") < end)
              .select(F.col("__mx_no").alias("source_no"), "__mx_part", "__mx_row", "doc_id", *keys, "__mx_begin", "__mx_end",
                      F.explode(F.sequence(F.floor(F.col("__mx_begin") / block), F.floor((end - 1) / block))).alias("rank"))
              .withColumn("words", F.least(end, (F.col("rank") + 1) * block) - F.greatest(F.col("__mx_begin"), F.col("rank") * block))
              .withColumn("at", F.greatest(F.col("__mx_begin") - F.col("rank") * block, F.lit(0)).cast("long"))
              .withColumn("begin", F.greatest(F.col("rank") * block - F.col("__mx_begin"), F.lit(0)).cast("long"))
              .withColumn("until", F.col("begin") + F.col("words")))
    slots = schedule(spark, per.select("source_no", "quota"))
    named = F.array_sort(F.collect_list("slot"))  # as many as the document has blocks
    taken = (pieces.join(slots, ["source_no", "rank"]).groupBy(F.col("source_no").alias("__mx_no"), "__mx_part", "__mx_row")
             .agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_slots"), F.min("slot").alias("first_slot"), F.md5(F.array_join(named, ",").cast("binary")).alias("slots_md5")))
    mixed = (stream.join(taken, ["__mx_no", "__mx_part", "__mx_row"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "n_slots")})
             .drop("__mx_goal", "__mx_no", "__mx_part", "__mx_row", "__mx_at"))
    return mixed, slots, pieces.select("source_no", "rank", "at", "doc_id", "begin", "until", "words", *keys)


def with_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the columns ``ADDED``; texts meet their row by a key, in one shuffle.

    Rows that agree in id and text share a key, and their texts are one."""
    key = F.xxhash64("doc_id", "text")
    slim = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED], key.alias("mix_key"))
    texts = slim.select("mix_key", F.col("doc_id").alias("mix_id"), F.col("text").alias("mix_text")).dropDuplicates(["mix_key", "mix_id"])
    mixed = mix(slim)[0]
    joined = mixed.join(texts, (mixed["mix_key"] == texts["mix_key"]) & mixed["doc_id"].eqNullSafe(texts["mix_id"])).drop(texts["mix_key"])
    return joined.withColumn("text", F.col("mix_text")).drop("mix_key", "mix_id", "mix_text")


def mixed_texts(docs: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The mix itself: ``(slot, at, source, doc_id, begin, until, text)`` and the columns ``keep`` of the row, a row per piece of a block, in schedule order.

    ``text`` holds the words ``begin`` to ``until`` of the document with what stands between them, so a
    document taken twice is there twice and one taken in part is cut.  ``options`` are those of ``mix``.
    Each text meets the list of its pieces once (a few numbers per block of words) and is split once."""
    slim = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("mix_key"), F.struct(F.lit(0).alias("__mx"), *[F.col(f"`{c}`") for c in keep]).alias("mix_kept"))
    texts = slim.select("mix_key", F.col("doc_id").alias("mix_id"), F.col("text").alias("mix_text")).dropDuplicates(["mix_key", "mix_id"])
    _, slots, pieces = mix(slim, keys=("mix_key", "source", "mix_kept"), **options)
    taken = (pieces.join(slots, ["source_no", "rank"])
             .groupBy("mix_key", "doc_id").agg(F.collect_list(F.struct("slot", "at", "source", "begin", "until", "mix_kept")).alias("mix_pieces")))
    joined = taken.join(texts, (taken["mix_key"] == texts["mix_key"]) & taken["doc_id"].eqNullSafe(texts["mix_id"]))
    split = F.regexp_extract_all("mix_text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    # a name of the lambda is computed once; a column might be split anew for each piece
    cut = F.transform(F.array(split), lambda words: F.transform("mix_pieces", lambda p: F.struct(
        p["slot"].alias("slot"), p["at"].alias("at"), p["source"].alias("source"), p["begin"].alias("begin"), p["until"].alias("until"), p["mix_kept"].alias("kept"),
        F.regexp_replace(F.array_join(F.slice(words, (p["begin"] + 1).cast("int"), (p["until"] - p["begin"]).cast("int")), ""), r"^[\x20\x09-\x0D]+", "").alias("text"))))
    return (joined.select("doc_id", F.explode(cut[0]).alias("p")).select("p.slot", "p.at", "p.source", "doc_id", "p.begin", "p.until", "p.text", *[F.col("p.kept").getField(c).alias(c) for c in keep])
            .orderBy("slot", "at"))


def mixture(docs: DataFrame) -> DataFrame:
    """The contract's columns from ``mix``."""
    return mix(docs.select("doc_id", "source", "text"))[0].select("doc_id", *ADDED)


# What of each document lies before its source's goal in two passes; and the schedule, point by point.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, (CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
f AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
             sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM w),
o AS (SELECT words, heavy FROM f WHERE cap * heavy > weight * words ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT w.source, source_size, CASE WHEN cap * o.heavy > weight * o.words THEN weight * o.words / o.heavy ELSE cap END AS target
      FROM w LEFT JOIN o ON true),
a AS (SELECT d.doc_id, d.source, size, source_size, target, least(round(target)::BIGINT, 2 * source_size) AS goal,
             (sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', '17', d.doc_id)), d.doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS begins
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT t.source, place, ceil(least(round(target)::BIGINT, 2 * t.source_size) / 256.0)::BIGINT AS quota FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source),
n AS (SELECT sum(quota)::BIGINT AS total, count(*) AS sources FROM q),
h AS (SELECT place, quota, (sum(quota) OVER (ORDER BY place))::DOUBLE / total AS hi, (sum(quota) OVER (ORDER BY place) - quota)::DOUBLE / total AS lo FROM q, n WHERE quota > 0),
i AS (SELECT unnest(range(total)) AS slot FROM n),
p AS (SELECT slot, (slot // 1048576) * {high}::DOUBLE + (slot % 1048576) * {low}::DOUBLE AS p FROM i),
r AS (SELECT slot, place, quota, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank
      FROM (SELECT slot, p - floor(p) AS p FROM p) p JOIN h ON p.p >= lo AND (p.p < hi OR (hi >= 1 AND p.p >= 1))),
z AS (SELECT slot, place, rank FROM r WHERE rank < quota UNION ALL
      SELECT total + rank * sources + place, place, rank FROM (SELECT place, unnest(range(coalesce(got, 0), quota)) AS rank FROM q LEFT JOIN (SELECT place, count(*) AS got FROM r GROUP BY place) USING (place)), n),
e AS MATERIALIZED (SELECT row_number() OVER () AS row, a.*, s.place FROM a JOIN s ON a.source IS NOT DISTINCT FROM s.source),
g AS (SELECT row, place, unnest([begins, begins + source_size]) AS b, size, goal FROM e WHERE size > 0),
k AS (SELECT row, place, unnest(range(b // 256, (least(b + size, goal) - 1) // 256 + 1)) AS rank FROM g WHERE b < goal),
m AS (SELECT row, count(*) AS n_slots, min(slot) AS first_slot, md5(string_agg(slot::VARCHAR, ',' ORDER BY slot)) AS slots_md5 FROM k JOIN z USING (place, rank) GROUP BY row)
SELECT doc_id, size, source_size, target,
       least(greatest(goal - begins, 0), size) + least(greatest(goal - begins - source_size, 0), size) AS taken,
       coalesce(n_slots, 0)::BIGINT AS n_slots, first_slot::BIGINT AS first_slot, slots_md5 FROM e LEFT JOIN m USING (row)
""".replace("{high}", repr(float((PHI * _LOW) % 1))).replace("{low}", repr(float(PHI)))
