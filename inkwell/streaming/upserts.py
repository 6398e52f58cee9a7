"""Upserts from a stream, each batch exactly once.

    table = UpsertTable(spark, "s3a://bucket/users", schema, ["user_id"], merge)
    stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", ...).start()

The table lies in parts by a hash of its key. A batch rewrites the parts that its keys fall into, in a folder of its own, and then goes into the
ledger, which says for each part where it is. What isn't in the ledger isn't there: a batch that was cut off before it is written again, and one that
Spark delivers again after it changes nothing. A batch with a known number and other rows is a conflict.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "batch long, rows long, print string, home string, parts array<int>"
_PART = "_part"


class ConflictError(Exception):
    """A batch with the number of another."""


class UpsertTable:
    """``merge`` gets the rows of a part of the table and those of a batch, and gives the rows after it (``operators.upsert`` has the usual ones); it may only
    look at rows of one key at a time. ``parts`` is fixed when the table is made: a part should fit a few tasks."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], parts: int = 64) -> None:
        self.spark, self.folder, self.key, self.merge, self.parts = spark, folder.rstrip("/"), list(key), merge, parts
        self.empty = spark.createDataFrame([], schema)

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def ledger(self) -> list:
        """Entries in the order of their batches: a line for each batch that counts."""
        path, fs = self._fs(f"{self.folder}/ledger")
        if not fs.exists(path):
            return []
        return self.spark.read.schema(_ENTRY).json(f"{self.folder}/ledger/*").orderBy("batch").collect()

    def read(self) -> DataFrame:
        return self._rows(self.ledger(), None)

    def _rows(self, entries: list, parts: set[int] | None) -> DataFrame:
        home = {p: e["home"] for e in entries for p in e["parts"] if parts is None or p in parts}  # the last one counts
        paths = [f"{self.folder}/{h}/{_PART}={p}" for p, h in home.items()]
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def apply(self, batch: DataFrame, number: int) -> None:
        """What ``foreachBatch`` calls."""
        rows = batch.select(*self.empty.columns).withColumn(_PART, F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))
        rows = rows.persist()
        try:
            found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*self.empty.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("print"), F.array_sort(F.collect_set(_PART)).alias("parts")).first()
            entries = self.ledger()
            for e in entries:
                if e["batch"] == number:
                    if (e["rows"], e["print"]) != (found["n"], found["print"]):
                        raise ConflictError(f"batch {number} of {self.folder} has {found['n']} rows that aren't the {e['rows']} of before")
                    return
            home = f"batch-{number}-{uuid.uuid4().hex[:8]}"
            if found["n"]:
                after = self.merge(self._rows(entries, set(found["parts"])), rows.drop(_PART))
                after = after.withColumn(_PART, F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))
                after.repartition(_PART).write.partitionBy(_PART).parquet(f"{self.folder}/{home}")
            # parts that the merge left empty have no folder
            kept = [p for p in found["parts"] if (at := self._fs(f"{self.folder}/{home}/{_PART}={p}"))[1].exists(at[0])]
            self._commit((number, found["n"], found["print"], home, kept))
        finally:
            rows.unpersist()

    def _commit(self, entry: tuple) -> None:
        """The entry comes whole, by a rename, and only if no other run of the batch was quicker."""
        name = f"{self.folder}/ledger/{entry[0]:012d}"
        self.spark.createDataFrame([entry], _ENTRY).coalesce(1).write.mode("errorifexists").json(f"{self.folder}/{entry[3]}/entry")
        (source, fs), (target, _), (parent, _) = self._fs(f"{self.folder}/{entry[3]}/entry"), self._fs(name), self._fs(f"{self.folder}/ledger")
        fs.mkdirs(parent)
        if fs.exists(target) or not fs.rename(source, target):
            raise ConflictError(f"batch {entry[0]} of {self.folder} was written by another run")

    def clean(self) -> int:
        """Remove folders of batches that no part of the table lies in; how many."""
        used = {e["home"] for e in self.ledger()}
        last = {p: e["home"] for e in self.ledger() for p in e["parts"]}
        path, fs = self._fs(self.folder)
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch-") and (s.getPath().getName() not in used or s.getPath().getName() not in last.values())]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
