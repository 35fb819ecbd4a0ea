"""Stored partials as levelled runs.

Each arrival is written as a run of its own; ``fanout`` runs of a level are merged into one of the next, so a row is
written again about log(arrivals) times and not with every arrival.  A version is the list of runs that hold it, written whole
before a pointer names it; readers merge on read and see a whole version.  Runs that neither the current version nor the one
before names are deleted.  Merging moves partial rows only, a row per group and run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import ReduceSpec
from ..streaming.incremental import point_to
from ..streaming.keyed import clean, folders_of, versions, write_version
from .reduce import merge_incremental, merge_partials, union_partials


class StoredPartials:
    """Partial rows of one reduce under ``home``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, home: str, spec: ReduceSpec, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.home, self.spec, self.fanout = spark, home.rstrip("/"), spec, fanout

    def runs(self) -> list[str]:
        """Folders of the current version, named ``run-<arrival>-<level>``."""
        epochs = versions(self.spark, self.home)
        return folders_of(self.spark, self.home, epochs[-1]) if epochs else []

    def _frames(self, runs: list[str]) -> DataFrame:
        return union_partials([self.spark.read.parquet(f"{self.home}/{r}") for r in runs])  # a few: fanout per level

    def append(self, parts: DataFrame) -> None:
        """Add newly arrived partial rows; an append that is run again after a failure starts from the last whole version."""
        epochs, held = versions(self.spark, self.home), self.runs()
        epoch = epochs[-1] + 1 if epochs else 0
        runs, level = [*held, f"run-{epoch}-0"], 0
        parts.write.mode("overwrite").parquet(f"{self.home}/{runs[-1]}")
        while len(full := [r for r in runs if r.endswith(f"-{level}")]) >= self.fanout:
            level += 1
            merge_incremental(None, self._frames(full), self.spec).write.mode("overwrite").parquet(f"{self.home}/run-{epoch}-{level}")
            runs = [*[r for r in runs if r not in full], f"run-{epoch}-{level}"]
        write_version(self.spark, self.home, epoch, runs)
        point_to(self.spark, self.home, epoch)
        clean(self.spark, self.home, {*held, *runs}, {epoch, *epochs[-1:]})

    def partials(self) -> DataFrame | None:
        """The stored partial rows (several per group, one per run that has it)."""
        runs = self.runs()
        return self._frames(runs) if runs else None

    def read(self) -> DataFrame | None:
        """The merged reduce of all that arrived."""
        parts = self.partials()
        return merge_partials(parts, self.spec) if parts is not None else None
