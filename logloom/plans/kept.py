"""Partial aggregates kept beside a store's snapshots, one for each part.

The three tables are cut by the same hash of the session id, so a part of them
has whole sessions.  A part's partial has the name of the folders that it was
made from: folders never change, so a partial is there or it isn't.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators import partials
from logloom.operators.sessions import Tables
from logloom.plans.store import Store, part_of

TABLES = ("session", "message", "tool_call")


@dataclass
class Kept:
    store: Store

    @property
    def path(self) -> str:
        return f"{self.store.path}/partials"

    def _names(self) -> dict[int, str]:
        """Name of the partial that each part should have."""
        places = self.store._places()
        parts = sorted({int(k) for t in TABLES for k in places[t]})
        return {k: f"{k}-{hashlib.sha1('|'.join(places[t].get(str(k), '') for t in TABLES).encode()).hexdigest()}" for k in parts}

    def _found(self) -> set[str]:
        fs, path = self.store._fs()
        folder = path(self.path)
        return {x.getPath().getName() for x in fs.listStatus(folder)} if fs.exists(folder) else set()

    def refresh(self) -> list[int]:
        """Makes the partials of parts that have none, drops those of parts that are gone; returns the parts read."""
        store, names, found = self.store, self._names(), self._found()
        fs, path = store._fs()
        for old in found - set(names.values()):
            if not old.startswith("."):
                fs.delete(path(f"{self.path}/{old}"), True)
        missing = [k for k, n in names.items() if n not in found]
        if missing:
            t = Tables(*[store.table(name, missing) for name in TABLES])
            staged = f"{self.path}/.{uuid.uuid4().hex}"
            rows = partials.partial(t, part_of("session_id")).withColumn("of", F.col("part"))
            rows.repartition("of").write.partitionBy("of").parquet(staged)
            for k in missing:
                fs.mkdirs(path(f"{staged}/of={k}"))
                fs.rename(path(f"{staged}/of={k}"), path(f"{self.path}/{names[k]}"))
            fs.delete(path(staged), True)
        return missing

    def rows(self) -> DataFrame:
        """The merged partials of the current snapshot."""
        self.refresh()
        folders = [f"{self.path}/{n}" for n in self._names().values()]
        spark = self.store.spark
        read = spark.read.schema(partials.SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], partials.SCHEMA)
        return partials.merged(read)

    def digest(self) -> dict[str, Any]:
        rows = self.rows().persist()
        try:
            return partials.digest(rows)
        finally:
            rows.unpersist()
