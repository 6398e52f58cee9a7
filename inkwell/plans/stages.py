"""Batch jobs in stages that go on where they were stopped."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]


def generation_id(*parts: object) -> str:
    """A name for what a job was started with: other input, or another version of a rule, is another generation."""
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:16]


class StagedJob:
    """``stages`` in turn, each a function of (spark, the result before it).

    A stage's result is written under the generation's folder and then entered in its manifest, by a rename. A run of the same generation reads what the manifest has and goes on
    with the next stage, so a job killed at any point ends with the same table; files of a stage that isn't in the manifest are written anew. Another generation
    starts afresh beside it. At ``deadline`` seconds a run stops between two stages.
    """

    def __init__(self, spark: SparkSession, folder: str, generation: str, stages: Sequence[Stage]) -> None:
        self.spark, self.stages = spark, list(stages)
        self.home = f"{folder.rstrip('/')}/generation={generation}"
        if len({name for name, _ in stages}) < len(self.stages):
            raise ValueError("stages need different names")

    def _path(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def done(self) -> list[str]:
        """Stages that the manifest has, in order; one after a gap doesn't count."""
        out = []
        for k, (name, _) in enumerate(self.stages):
            path, fs = self._path(self._entry(k, name))
            if not fs.exists(path):
                break
            out.append(name)
        return out

    def _entry(self, k: int, name: str) -> str:
        return f"{self.home}/manifest/{k:03d}-{name}"

    def run(self, deadline: float | None = None) -> DataFrame | None:
        """The last stage's result, or null if time ran out before."""
        began, n = time.monotonic(), len(self.done())
        result = self.spark.read.parquet(f"{self.home}/{self.stages[n - 1][0]}") if n else None
        for k, (name, stage) in list(enumerate(self.stages))[n:]:
            if deadline is not None and time.monotonic() - began >= deadline:
                return None
            stage(self.spark, result).write.mode("overwrite").parquet(f"{self.home}/{name}")
            self._enter(k, name)
            result = self.spark.read.parquet(f"{self.home}/{name}")
        return result

    def _enter(self, k: int, name: str) -> None:
        (path, fs), (draft, _) = self._path(self._entry(k, name)), self._path(f"{self.home}/draft-{k:03d}")
        fs.mkdirs(path.getParent())
        fs.delete(draft, True)
        fs.create(draft).close()
        if not fs.rename(draft, path):
            raise RuntimeError(f"stage {name} of {self.home} was entered by another run")
