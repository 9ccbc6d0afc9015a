"""Tables written to the folder that all machines of a cluster share.

Cutting lineage with a written table keeps a job restartable when executors
are lost: what was written is read again instead of being computed again.
"""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker; long texts then come in smaller batches.
BATCH_BYTES = 4 << 20


#: Folders that this session made below the shared one.
_CREATED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that setting is missing, a local session (tests) uses a temporary
    folder; on a cluster its absence is an error, because a local folder would
    not be seen by the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    _CREATED.append(f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}")
    return _CREATED[-1]


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was written to the shared folder inside; results that read it must have been written by then."""
    start = len(_CREATED)
    try:
        yield
    finally:
        for path in _CREATED[start:]:
            delete(spark, path)
        del _CREATED[start:]


def write_shared(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as Parquet to a shared folder and returns the reread table."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """Tables of one run, below one new shared folder; those that nothing reads any more can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, shared_dir(spark), {}

    def write(self, df: DataFrame) -> DataFrame:
        """Writes df as Parquet and returns the reread table."""
        path = f"{self.base}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that write returned; others are left alone."""
        for t in tables:
            if id(t) in self.paths:
                delete(self.spark, self.paths[id(t)][0])


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Spark drops a finished job's shuffle files when the driver collects its garbage, which can be long after."""
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(key: Any, make: Callable[[], Any]) -> Any:
    """What make returns, made once in a worker process; functions pickled by value have no lasting globals.

    Only the last value is kept: a worker that goes on with another operator
    lets go of the former one's tables before it makes its own.
    """
    kept = sys.__dict__.setdefault("_logloom_worker_cache", {})
    if key not in kept:
        kept.clear()
        value = make()
        kept.clear()
        kept[key] = value
    return kept[key]


def thinned(rows: DataFrame, group: str, by: str, most: int) -> DataFrame:
    """Rows whose hash of ``by`` is low, about twice ``most`` of every larger group and all of a smaller one.

    The cut comes from the groups' counts, so that a later choice of the first
    ``most`` in the same order reads few rows of each group.
    """
    counts = checked(write_shared(rows.groupBy(group).agg(F.count("*").alias("_rows"))))
    share = F.pmod(F.xxhash64(by), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(counts, group).filter((F.col("_rows") <= 4 * most) | (share * F.col("_rows") <= 2 * most)).drop("_rows")


def send(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast whose classes travel by value, too."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> Any:
    return pickle.loads(sent.value)


#: Most rows of a few numbers each that are broadcast after their count was checked.
BROADCAST_ROWS = 400_000


def checked(keys: DataFrame) -> DataFrame:
    """keys (a written table of a few numbers a row) marked for a broadcast if it is small; else Spark shuffles both sides."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys
