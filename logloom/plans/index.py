"""The posting table beside a store's messages.

Parts of the message table are folders that never change, so each has its own
postings, in a folder of the same name: a new snapshot of a part has none, and
that is all there is to staleness.  Postings are cut into BUCKETS by a hash of
the trigram; a search reads the buckets of its query's trigrams and no others.
A part's index counts once its file STATS stands.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators import postings as ps
from logloom.operators import search as scan
from logloom.operators.search import pack, short_match
from logloom.plans.store import SCHEMAS, Store, part_of

BUCKETS = 16
#: Messages of a part that one task indexes, and files that a bucket of it then has.
ROWS_PER_FILE = 200_000
KEY = ["session_id", "seq"]
POSTING = "gram string, session_id string, seq long, pos int, d int, src string, bucket int"


@dataclass
class Index:
    store: Store

    @property
    def path(self) -> str:
        return f"{self.store.path}/postings"

    def _parts(self) -> dict[str, str]:
        """Folder of each part of the message table, by the name of its index."""
        return {f.replace("/message/part=", "-"): f for f in self.store._places()["message"].values()}

    def _names(self) -> set[str]:
        """Names of the indexes that stand."""
        fs, path = self.store._fs()
        folder = path(self.path)
        found = fs.listStatus(folder) if fs.exists(folder) else []
        return {x.getPath().getName().removeprefix("src=") for x in found if x.getPath().getName().startswith("src=")}

    def stats(self) -> dict[str, dict[str, int]]:
        """Rows and sum of lengths of each indexed part of the current snapshot."""
        kept = {n: self.store._read_text(f"postings/src={n}/STATS") for n in sorted(self._names() & set(self._parts()))}
        return {n: json.loads(s) for n, s in kept.items() if s}

    def stale(self) -> list[str]:
        """Parts without an index."""
        return sorted(set(self._parts()) - set(self.stats()))

    def status(self) -> dict[str, Any]:
        """Rows indexed, rows that should be, and whether they agree."""
        parts, own = self._parts(), self.stats()
        texts = self.store.table("message").filter("text is not null").count()
        indexed = sum(s["rows"] for s in own.values())
        return {"index_rows": indexed, "message_rows": texts, "stale_parts": len(parts) - len(own), "fresh": len(parts) == len(own) and indexed == texts}

    def refresh(self) -> list[str]:
        """Indexes the parts that have no index, drops the indexes of parts that are gone; returns the parts indexed."""
        fs, path = self.store._fs()
        parts = self._parts()
        for old in self._names() - set(parts):
            fs.delete(path(f"{self.path}/src={old}"), True)
        missing = self.stale()
        if not missing:
            return []
        spark = self.store.spark
        read = spark.read.schema(SCHEMAS["message"]).parquet(*[f"{self.store.path}/{parts[n]}" for n in missing])
        src = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/message/part=\d+)/[^/]*$", 1), "/message/part=", "-")
        rows = read.select("session_id", "seq", "text", src.alias("src")).filter("text is not null")
        sums = {r["src"]: {"rows": r["rows"], "sum_d": r["sum_d"]} for r in rows.groupBy("src").agg(F.count("*").alias("rows"), F.sum(ps.length(F.col("text"))).alias("sum_d")).collect()}  # one row a part
        files = max(1, -(-max((s["rows"] for s in sums.values()), default=0) // ROWS_PER_FILE))
        made = ps.postings(rows, ["src", *KEY]).withColumn("bucket", ps.bucket_of(F.col("gram"), BUCKETS))
        staged = f"{self.path}/.{uuid.uuid4().hex}"
        # a frequent trigram's postings are dealt to as many tasks as the part has files
        dealt = made.repartition("src", "bucket", F.pmod(F.xxhash64(*KEY), F.lit(files)))
        dealt.sortWithinPartitions("src", "bucket", "gram", *KEY, "pos").write.partitionBy("src", "bucket").parquet(staged)
        for name in missing:
            self._place(f"{staged}/src={name}", name, sums.get(name, {"rows": 0, "sum_d": 0}))
        fs.delete(path(staged), True)
        return missing

    def _place(self, staged: str, name: str, stats: dict[str, int]) -> None:
        """Puts a part's index in its place, whole or not at all; one that stands already stays."""
        fs, path = self.store._fs()
        fs.mkdirs(path(staged))  # a part of short texts has no postings
        out = fs.create(path(f"{staged}/STATS"), True)
        out.write(bytearray(json.dumps(stats).encode()))
        out.close()
        target = path(f"{self.path}/src={name}")
        if fs.exists(target) and not fs.exists(path(f"{self.path}/src={name}/STATS")):
            fs.delete(target, True)
        if not fs.exists(target):
            fs.rename(path(staged), target)

    def read(self, grams: list[str]) -> DataFrame:
        """Postings of these trigrams: the files of their buckets, in the parts of the current snapshot."""
        spark = self.store.spark
        fs, path = self.store._fs()
        wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(ps.bucket_of(F.col("gram"), BUCKETS)).distinct().collect()
        folders = [f"{self.path}/src={n}/bucket={r[0]}" for n in self.stats() for r in wanted]
        folders = [f for f in folders if fs.exists(path(f))]
        if not folders:
            return spark.createDataFrame([], POSTING)
        return spark.read.option("basePath", self.path).schema(POSTING).parquet(*folders).filter(F.col("gram").isin(*grams))

    def counts(self, phrase: str) -> DataFrame:
        """session_id, seq, f, d, rank of every message that holds the phrase; refreshes the index first."""
        self.refresh()
        stats = self.stats().values()
        rows, total = sum(s["rows"] for s in stats), sum(s["sum_d"] for s in stats)
        found = ps.phrase_counts(self.read(list(ps.covering(phrase))), KEY, phrase)
        hits = found.agg(F.count("*").alias("_hits"))
        return ps.ranked(found.crossJoin(F.broadcast(hits)), F.lit(rows), F.col("_hits"), F.lit(total / rows if rows else 0.0)).drop("_hits")

    def best(self, query: str, limit: int, kinds: tuple[str, ...] = ("real", "meta")) -> DataFrame:
        """The best hits, at most limit: session, source, project, ts, text, rank, nth; as search.session_hits ranks them.

        Their texts are read from the messages by session ids, which the scan
        of the table filters by.
        """
        store, query = self.store, query.strip()
        own = store.table("session").filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("session_id"), "source", "project")
        if len(query) < ps.GRAM:
            rows = store.table("message").filter("text is not null").filter(short_match(F.col("text"), query)).join(own, "session_id")
            top = rows.withColumn("rank", F.lit(None).cast("double")).orderBy(F.desc("ts"), *KEY).limit(limit)
            order = [F.desc("ts"), *KEY]
        else:
            chosen = self.counts(query).join(own, "session_id").orderBy("rank", *KEY).limit(limit).collect()  # limit rows
            spark = store.spark
            held = spark.createDataFrame([(r["session_id"], r["seq"], r["source"], r["project"], r["rank"]) for r in chosen], "session_id string, seq long, source string, project string, rank double")
            ids = sorted({r["session_id"] for r in chosen})
            parts = [r[0] for r in held.select(part_of("session_id")).distinct().collect()]
            top = store.table("message", parts).filter(F.col("session_id").isin(*ids)).join(F.broadcast(held), KEY)
            order = ["rank", *KEY]
        nth = F.row_number().over(Window.orderBy(*order))
        return top.select(F.col("session_id").alias("session"), "source", "project", "ts", "text", "rank", nth.alias("nth"))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return self.best(query, limit).orderBy("nth").select("session", "source", "project", "ts", "text")

    def pack(self, query: str, budget: int, limit: int = 200) -> tuple[DataFrame, int]:
        """As search.session_pack."""
        hits = self.best(query, limit)
        packed = pack(hits, budget, ["nth"]).orderBy("nth")
        return packed.select("session", "source", "project", "ts", "excerpt", "used"), hits.count()


def scanned(store: Store, query: str, limit: int = 20) -> DataFrame:
    """The same search by a scan of all messages."""
    t = store.tables()
    return scan.session_search(t.message, t.session, query, limit)
