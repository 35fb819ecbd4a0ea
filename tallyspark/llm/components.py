"""Connected components of a link table: union-find inside tasks, star contraction between them.

Each task first joins the links it holds by union-find and passes on one link per node.  Large-star
and small-star steps (after Kiveris et al. 2014, on links that point from the larger node to the smaller) then re-link every node to the smallest one it knows, as
map-side-combined minimums and shuffle joins, until nothing changes or at most ``FLUSH_LINKS`` links
are left, which one task finishes in bounded memory.  Each round is written to the
shared folder; a node with very many links is only ever a key of partial aggregates and of joins that
adaptive execution can split.  Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging

FLUSH_LINKS = 200_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each non-minimal node to the smallest node of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        a, b = union_find(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size > FLUSH_LINKS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _large_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Every node ``a`` moves from its smaller neighbour ``b`` to the least one that ``b`` knows (itself if none)."""
    known = least.select(F.col("a").alias("via"), "m")
    return links.join(known, F.col("b") == F.col("via"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, staging: Staging, name: str, joined: bool = False) -> DataFrame:
    """``(id, component)`` for every non-minimal node of ``links`` ``(a, b)`` (longs): its smallest reachable node.

    ``joined``: the links come from ``union_find`` already, larger node first."""
    links = staging.table(f"{name}-0", links if joined else links.where("a != b").mapInArrow(_contract, "a long, b long"))
    last, step = None, 0
    while True:
        state = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state[0] <= FLUSH_LINKS:  # what is left fits one flush of one task: union-find ends it
            links = staging.table(f"{name}-end", links.coalesce(1).mapInArrow(_contract, "a long, b long"))
        if state == last or state[0] <= FLUSH_LINKS:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
        last, step = state, step + 1
        # a table of its own, so that the join's other side can be split where one node has very many links
        least = staging.table(f"{name}-{step}-least", links.groupBy("a").agg(F.min("b").alias("m")))
        links = staging.table(f"{name}-{step}", _small_star(_large_star(links, least)))
        staging.remove(f"{name}-{step - 1}", f"{name}-{step}-least")
