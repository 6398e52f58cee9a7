"""Intermediate tables in the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents without an id sort after all others.
LAST_ID = (1 << 63) - 1

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session uses a folder under its warehouse; on a cluster there is no
    folder that all machines surely share, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return folder.rstrip("/")


def stored(df: DataFrame, *sort: str, into: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends there.

    ``sort`` orders the rows within each file. The files go on ``release`` or when the Python process ends.
    """
    spark = df.sparkSession
    path = into or f"{shared_folder(spark)}/inkwell/{uuid.uuid4().hex}"
    if not into:
        remove_at_exit(spark, path)
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def remove_at_exit(spark: SparkSession, path: str) -> None:
    _written.append((spark, path))


#: Tables of the catalog that stand in a folder of their own name begin with this.
TABLE = "inkwell_run_"


def _delete(spark: SparkSession, path: str) -> None:
    if (name := path.rsplit("/", 1)[-1]).startswith(TABLE):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove(spark: SparkSession, path: str) -> None:
    _delete(spark, path)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be reached any more
            return


def release(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables, when all that was made from them is stored itself."""
    for t in tables:
        found = [x for x in _written if x[1] == getattr(t, "stored_at", None)]
        for x in found:
            remove(*x)


def written_so_far() -> int:
    """A mark for ``release_since``."""
    return len(_written)


def release_since(mark: int, *but: DataFrame) -> None:
    """Remove the stored tables made after ``mark``, save those in ``but``."""
    kept = {getattr(t, "stored_at", None) for t in but}
    for x in [x for x in _written[mark:] if x[1] not in kept]:
        remove(*x)


def join_evenly(rows: DataFrame, side: DataFrame, on: list[str], times: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has each key once and in ``times`` about how many rows have it.

    A key with over a thousandth of the rows would burden one task: these, at most a thousand, are broadcast. ``how``: inner or left_semi.
    ``side`` should be stored: it is read three times, ``rows`` twice.
    """
    total = side.agg(F.sum(times)).first()[0] or 0
    hot = side.where(F.col(times) * 1000 > total)
    few = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on, how).unionByName(rows.join(few, on, "left_anti").join(side.where(F.col(times) * 1000 <= total), on, how))


def order_id(name: str):
    """The id that orders documents: null sorts last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about ``limit`` bytes of text (a longer row comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` and after it ``fields`` (DDL), which may be null."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])
