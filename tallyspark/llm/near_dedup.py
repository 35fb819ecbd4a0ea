"""Near-duplicate groups: SuperMinHash, banding, verification, union-find.

* Each text becomes the set of its distinct ``width``-word shingles (64-bit hashes) and a SuperMinHash
  signature (Ertl 2017): element ``i`` visits the slots in an order of its own (a Fisher-Yates shuffle
  per element) and leaves rank + uniform there; a slot keeps the least.  Ranks are processed for all
  elements of a slice at once, and a text stops as soon as all its slots are taken.
* Texts of equal sets form a class, represented by its smallest id; copies cost nothing further.
* ``bands`` hashes of ``rows`` slots each put the representatives into buckets.  A pair at the threshold
  misses every bucket with probability (1 - s^rows)^bands, below 1e-6.
* Every member is verified on full sets against its bucket's smallest member; the links found are
  grouped.  That is linear in the bucket and settles most buckets.
* Only buckets that still hold several groups go on.  A bucket is cut into blocks of about ``BLOCK`` members, its
  largest group apart from the rest (its members need no comparison among themselves).  Each pair of blocks is a task
  in two steps: a pair of members is wanted if its groups differ, its sizes allow a link, no earlier band has
  it too (that band's bucket owns it) and their sketches (a byte of each slot) agree in as many slots as all but
  ``MISS`` of the pairs at the threshold do; then the members with a wanted pair, and no others, bring their full sets, whose intersections
  are counted with a 0/1 matrix product, at most one link per group.
* The links of both steps give the components.

Nothing is dropped for size, and no pair without a common bucket is compared; no task holds more than two blocks; nothing
grows on the driver.  A bucket of k members without a large group costs k^2 / BLOCK rows of sketches, and of sets where
its members are near the threshold.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with
nothing; fewer words than ``width`` are one shingle; rows that repeat a ``doc_id`` are one node of the
graph; a row without ``doc_id`` is linked with nothing, has no component and is kept; an empty table
gives an empty result; extra columns stay in ``near_dedup`` and play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, union_find
from .staging import Staging, bounded_batches
from .tokens import mix, runs_of, shingle_sets, slices

SLOTS = 120
BLOCK = 128
COLUMNS = 1 << 14
PART_BYTES = 1 << 20
MISS = 1e-7
_MAX = np.uint64(2**64 - 1)


def superminhash(elements: np.ndarray, owner: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots); a text without elements keeps the maximum everywhere."""
    flat = np.full(texts * slots, _MAX, np.uint64)
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    for rank in range(slots):
        if not len(elements):
            break
        draw = mix(elements + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = rank + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        here = np.arange(len(elements))
        slot = order[here, pick]
        order[here, pick] = order[:, rank]
        cell = owner * slots + slot
        value = (np.uint64(rank) << np.uint64(56)) | (draw >> np.uint64(8))
        better = value < flat[cell]
        np.minimum.at(flat, cell[better], value[better])
        full = (flat.reshape(texts, slots) != _MAX).all(axis=1)
        open_ = ~full[owner]
        if open_.sum() < 0.7 * len(elements):  # texts whose slots are all taken stop here
            elements, owner, order = elements[open_], owner[open_], order[open_]
    return flat.reshape(texts, slots)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), 1))
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def _class_hash(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over a set's members, each through a mixer of its own."""
    bounds = runs_of(owner, texts)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)))])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]]))
    return out[0], out[1]


def _profile(width: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), PART_BYTES):
                hashes, owner = shingle_sets(part, width)
                signatures = superminhash(hashes, owner, part.rows)
                keys = band_hashes(signatures, bands, rows).view(np.int64)
                sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLOTS), part.rows, [None, pa.py_buffer(mix(signatures).astype(np.uint8).tobytes())]).cast(pa.binary())
                c1, c2 = _class_hash(hashes, owner, part.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.rows), pa.array(np.bincount(owner, minlength=part.rows).astype(np.int64)),
                     pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists, sketches],
                    names=["doc_id", "n_shingles", "c1", "c2", "bands", "sketch"])
    return work


def _sets(width: int):
    """(id, cls, text) to (id, cls, members): the ascending shingle hashes as bytes; rows of another class fall out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2), PART_BYTES):
                hashes, owner = shingle_sets(part, width)
                c1, _ = _class_hash(hashes, owner, part.rows)
                bounds = runs_of(owner, part.rows)
                members = pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                cls = batch.column(1).slice(part.first, part.rows)
                same = pa.array(cls.to_numpy(zero_copy_only=False) == c1.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.rows), cls, members], names=["id", "cls", "members"]).filter(same)
    return work


def _verify(percent: int):
    """(a, b, set of a, set of b) to the links that hold, joined by union-find within a batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            a, b = union_find(*(batch.column(c).to_numpy(zero_copy_only=False)[good] for c in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return work


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` with sets ``right``, by 0/1 matrix products over stretches of the shared shingles."""
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for begin in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[row[a:b], column[a:b] - begin] = 1
        out += table[left] @ table[right].T
    return out


def least_agreement(percent: int, slots: int = SLOTS, miss: float = MISS) -> int:
    """The number of equal slots that a pair at the threshold stays below with probability under ``miss``."""
    p, below = percent / 100, 0.0
    for k in range(slots + 1):
        below += math.comb(slots, k) * p**k * (1 - p) ** (slots - k)
        if below >= miss:
            return k
    return slots


def _sides(key: tuple, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a pair of blocks that meet each other; a block that meets itself is both sides."""
    if key[1].as_py() == key[2].as_py():
        return np.arange(rows.num_rows), np.arange(rows.num_rows)
    side = rows.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _wanted(percent: int, agreement: int):
    """The rows of a pair of blocks with a partner to be compared with."""
    def work(key: tuple, rows: pa.Table) -> pa.Table:
        left, right = _sides(key, rows)
        label, n = rows.column("label").to_numpy(), rows.column("n").to_numpy()
        (la, lb), (na, nb) = ((x[left][:, None], x[right][None, :]) for x in (label, n))
        want = (la != lb) & (100 * na >= percent * nb) & (100 * nb >= percent * na)
        if want.any():
            bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            own = np.flatnonzero((bands == key[0].as_py()).all(axis=0))
            for k in range(own[0] if len(own) else 0):
                want &= bands[left, k][:, None] != bands[right, k][None, :]
        if want.any():
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            want &= (sketch[left][:, None, :] == sketch[right][None, :, :]).sum(axis=2) >= agreement
        here = np.union1d(left[want.any(axis=1)], right[want.any(axis=0)])
        return rows.select(["bucket", "i", "j", "side", "id", "cls", "label"]).take(pa.array(here, pa.int64()))
    return work


def _block_links(percent: int):
    def work(key: tuple, rows: pa.Table) -> pa.Table:
        label = rows.column("label").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("members")]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        left, right = _sides(key, rows)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = _intersections(sets, left, right)
        linked = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (label[left][:, None] != label[right][None, :])
        i, j = np.nonzero(linked)
        a, b = union_find(label[left[i]], label[right[j]])
        return pa.table({"a": a, "b": b})
    return work


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row: linked where 100 |A & B| >= percent |A | B|."""
    spark = docs.sparkSession
    bounded_batches(spark)
    staging = Staging(spark, "near-dedup")
    rows = 5 if percent >= 85 else 4
    bands = SLOTS // rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = staging.table("profile", texts.mapInArrow(_profile(width, bands, rows), "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, sketch binary"))

    # classes of equal sets; all rows of a class have the same bands
    reps = staging.table("reps", profile.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("c1", "c2")
                         .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    buckets = reps.select("id", F.col("c1").alias("cls"), "n", F.explode("bands").alias("bucket"))
    hubs = (buckets.groupBy("bucket").agg(F.min(F.struct("id", "cls", "n")).alias("hub"), F.count(F.lit(1)).alias("many"))
            .where("many > 1").select("bucket", F.col("hub.id").alias("hub"), F.col("hub.cls").alias("hub_cls"), F.col("hub.n").alias("hub_n")))
    members = staging.table("members", buckets.join(hubs, "bucket"))

    # verification against the bucket's smallest member
    wanted = members.select("id", "cls").distinct()
    chosen = texts.join(wanted, F.col("doc_id") == F.col("id")).select("id", "cls", "text")
    sets = staging.table("sets", chosen.mapInArrow(_sets(width), "id long, cls long, members binary"))
    near = (F.col("n") * 100 >= F.col("hub_n") * percent) & (F.col("hub_n") * 100 >= F.col("n") * percent)  # else the sizes rule it out
    pairs = members.where((F.col("id") != F.col("hub")) & near).select("id", "cls", "hub", "hub_cls").distinct()
    first = pairs.join(sets.withColumnRenamed("members", "x"), ["id", "cls"])
    second = first.join(sets.select(F.col("id").alias("hub"), F.col("cls").alias("hub_cls"), F.col("members").alias("y")), ["hub", "hub_cls"])
    links = second.select(F.col("id").alias("a"), F.col("hub").alias("b"), "x", "y").mapInArrow(_verify(percent), "a long, b long")
    groups = components(links, staging, "groups", joined=True)

    # what shares a bucket across groups
    labelled = members.join(groups, "id", "left").select("bucket", "id", "cls", F.coalesce("component", "id").alias("label"))
    by_label = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("many"))
    shape = (by_label.groupBy("bucket").agg(F.max(F.struct("many", "label")).alias("top"), F.sum("many").alias("all"))
             .where("all > top.many").select("bucket", F.col("top.label").alias("main"), F.ceil(F.col("top.many") / BLOCK).alias("main_blocks"),
                                             F.ceil((F.col("all") - F.col("top.many")) / BLOCK).alias("rest_blocks")))
    spread = F.xxhash64("id")
    dealt = labelled.join(shape, "bucket").withColumn("own", F.when(F.col("label") == F.col("main"), F.pmod(spread, "main_blocks") + F.col("rest_blocks"))
                                                      .otherwise(F.pmod(spread, "rest_blocks")))
    # blocks 0.. are the rest, then the largest group's; every pair of blocks meets but for two of the largest group
    meets = F.when(F.col("label") == F.col("main"), F.sequence(F.lit(0), F.col("rest_blocks") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("rest_blocks") + F.col("main_blocks") - 1))
    dealt = staging.table("dealt", dealt.select("bucket", "id", "cls", "label", "own", meets.alias("meets")))
    met = (dealt.join(reps.select("id", F.col("c1").alias("cls"), "n", "bands", "sketch"), ["id", "cls"])
           .select("bucket", "id", "cls", "label", "n", "bands", "sketch", "own", F.explode("meets").alias("other"))
           .select("bucket", "id", "cls", "label", "n", "bands", "sketch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                   (F.col("own") > F.col("other")).cast("int").alias("side")))
    wanted = met.groupBy("bucket", "i", "j").applyInArrow(_wanted(percent, least_agreement(percent)),
                                                          "bucket long, i long, j long, side int, id long, cls long, label long")
    blocks = staging.table("wanted", wanted).join(sets, ["id", "cls"])
    further = blocks.groupBy("bucket", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    merged = components(further, staging, "merged", joined=True)

    # every class to the smallest id that it reaches
    final = (reps.select("c1", "c2", "id").join(groups, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
             .join(merged.withColumnRenamed("id", "label"), "label", "left")
             .select("c1", "c2", F.coalesce("component", "label").alias("component")))
    final = staging.table("final", final)
    staging.keep("profile", "final")
    rows_ = profile.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c1")).alias("c1"), "c2")
    own = F.coalesce("component", "doc_id")
    return (rows_.join(final, ["c1", "c2"], "left")
            .select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document represents its group (the smallest ``doc_id``), with their own columns."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__nd_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__nd_id"), "left_anti")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: three-word shingles, 85 percent."""
    return near_duplicates(docs.select("doc_id", "text"), width=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b AS d, r.c FROM r JOIN e ON e.a = r.d)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, documents.doc_id = c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) ON d = documents.doc_id
"""
