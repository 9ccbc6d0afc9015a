"""Written tables between the steps of an iterative operator.

They cut the lineage, so what was computed survives lost executors.  They go
below spark.checkpoint.dir, which the machines of a cluster share; a local
session without that setting uses a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A new folder for the tables of one run; drop deletes a table, and clear all of them."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"{tempfile.gettempdir()}/checkpoints"
        self.spark, self.path, self.n = spark, f"{base.rstrip('/')}/steps-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """Writes df and returns the reread table."""
        path, self.n = f"{self.path}/{self.n}", self.n + 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.paths:
                self._delete(self.paths.pop(id(t))[0])

    def clear(self) -> None:
        self.paths.clear()
        self._delete(self.path)
