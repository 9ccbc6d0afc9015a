"""Versioned Parquet store with incremental ingest.

Tables are cut into PARTS by a hash of the session id (the manifest: of the
file).  An ingest writes the parts that it touches and then a pointer, a small
file POINTER-N that names the folder of every part; the newest pointer is in
force.  It comes into being by one rename to a new name, so that a failed
ingest leaves the old state.  The manifest records each file's stamps and
digest.  File names are listed on the driver, as by every file scan of Spark;
contents and tables aren't.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators import sessions
from logloom.operators.sessions import Tables
from logloom.sources import jsonl
from logloom.sources.registry import Source

SCHEMA_VERSION = "2"
SCHEMAS = {
    "session": "id string, source string, file_path string, project string, cwd_raw string, model string, originator string, started_at string, ended_at string, n_user long, n_asst long, out_tokens long, kind string, ingested_at timestamp",
    "message": "session_id string, seq long, ts string, role string, text string, is_task boolean, is_friction boolean, sig string",
    "tool_call": "session_id string, after_seq long, tool string, cmd_key string, file_ext string, workdir string, pkgs array<string>",
    "manifest": "file_path string, file_mtime timestamp, file_size long, content_hash string, session_id string",
}
KEYS = {"session": "id", "message": "session_id", "tool_call": "session_id", "manifest": "file_path"}
PARTS = 16
#: Bytes of a file beyond which its lines are put in order in segments.
LARGE_FILE = 1 << 28
OK, UNHEALTHY, EMPTY, CORRUPT, VERSION = 0, 1, 3, 5, 6


class StoreEmpty(Exception):
    code = EMPTY


class StoreVersion(Exception):
    code = VERSION


class StoreCorrupt(Exception):
    code = CORRUPT


def diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """listing (file_path, file_mtime, file_size) with old_hash, old_id, and status: skipped where the stamps are the manifest's, else check."""
    old = manifest.select("file_path", F.col("file_mtime").alias("_mtime"), F.col("file_size").alias("_size"), F.col("content_hash").alias("old_hash"), F.col("session_id").alias("old_id"))
    same = (F.abs(F.col("file_mtime").cast("double") - F.col("_mtime").cast("double")) < 1e-6) & (F.col("file_size") == F.col("_size"))
    return listing.join(old, "file_path", "left").withColumn("status", F.when(same, "skipped").otherwise("check")).drop("_mtime", "_size")


def decided(checked: DataFrame, filled: DataFrame | None) -> DataFrame:
    """Checked files with their session_id, and status: error (unreadable), unchanged (digest as before), empty (no session found), or ingested."""
    known = F.when(F.col("content_hash").isNull(), "error").when(F.col("content_hash") == F.col("old_hash"), "unchanged")
    joined = checked.join(filled, "file_path", "left") if filled is not None else checked.withColumn("session_id", F.lit(None).cast("string"))
    status = known.when(F.col("session_id").isNull(), "empty").otherwise("ingested")
    return joined.withColumn("status", status).withColumn("session_id", F.when(F.col("status") == "unchanged", F.col("old_id")).otherwise(F.col("session_id")))


def checksum(table: str, where: Column | None = None) -> Column:
    """The sum of the rows' hashes, which no order of rows changes, as an aggregate."""
    own = F.xxhash64(*[c.split()[0] for c in SCHEMAS[table].split(", ")]).cast("decimal(20, 0)")
    return F.coalesce(F.sum(own if where is None else F.when(where, own)), F.lit(0).cast("decimal(30, 0)"))


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def surviving(session: DataFrame, changed: DataFrame) -> DataFrame:
    """Of new sessions (id, file_path, ...) those that files taken in the order of their paths leave.

    Each changed file (file_path, old_id) first deletes the session it gave
    before, and then any with its new id: of one id the last file's session
    stays, unless a later file had given that id before.
    """
    later = changed.filter("old_id is not null").groupBy(F.col("old_id").alias("id")).agg(F.max("file_path").alias("_cut"))
    return latest(session, "id", "file_path").join(later, "id", "left").filter("_cut is null or _cut <= file_path").drop("_cut")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last in order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


@dataclass
class Store:
    spark: SparkSession
    path: str
    _opened: tuple[Any, Any] | None = field(default=None, repr=False, compare=False)

    def _fs(self) -> tuple[Any, Any]:
        if self._opened is None:
            jvm = self.spark.sparkContext._jvm
            make = jvm.org.apache.hadoop.fs.Path
            self._opened = make(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), make
        return self._opened

    def _read_text(self, name: str) -> str | None:
        """A small file beside the tables."""
        fs, path = self._fs()
        p = path(f"{self.path}/{name}")
        if not fs.exists(p):
            return None
        given = fs.open(p)
        try:
            return str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(given, "UTF-8")).strip()
        finally:
            given.close()

    def _write_text(self, name: str, value: str) -> None:
        """A new file, whole or not at all."""
        fs, path = self._fs()
        new = path(f"{self.path}/.{name}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(value.encode()))
        out.close()
        if not fs.rename(new, path(f"{self.path}/{name}")):
            fs.delete(new, False)
            raise StoreCorrupt(f"{name} exists in {self.path}: another ingest was faster")

    def keep(self, name: str, text: str) -> str:
        """Keeps a document beside the tables, in place of an older one; returns its path."""
        fs, path = self._fs()
        where = path(f"{self.path}/documents/{name}")
        out = fs.create(where, True)
        out.write(bytearray(text.encode()))
        out.close()
        return where.toString()

    def kept(self, name: str) -> str | None:
        return self._read_text(f"documents/{name}")

    def _pointers(self) -> list[str]:
        fs, path = self._fs()
        folder = path(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n for n in names if n.startswith("POINTER-"))

    def _state(self, pointer: str | None = None) -> dict[str, Any]:
        """places: the folder of each part of each table; marks: rows, checksum and files of each folder; notes: what else a commit left."""
        found = pointer or (self._pointers() or [None])[-1]
        return json.loads(self._read_text(found)) if found else {"places": {t: {} for t in SCHEMAS}, "marks": {}, "notes": {}}

    def _places(self, pointer: str | None = None) -> dict[str, dict[str, str]]:
        return self._state(pointer)["places"]

    def notes(self) -> dict[str, Any]:
        return self._state()["notes"]

    def _files(self, folder: str) -> dict[str, list[int]]:
        """Length and time of each data file of a folder."""
        fs, path = self._fs()
        where = path(f"{self.path}/{folder}")
        found = fs.listStatus(where) if fs.exists(where) else []
        return {f.getPath().getName(): [f.getLen(), f.getModificationTime()] for f in found if f.getPath().getName().startswith("part-")}

    def version(self) -> str | None:
        return self._read_text("VERSION")

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or some parts of it."""
        folders = sorted({f for k, f in self._places()[name].items() if parts is None or int(k) in parts})
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def tables(self) -> Tables:
        return Tables(self.table("session"), self.table("message"), self.table("tool_call"))

    def guard(self) -> None:
        """Raises where the version differs or nothing is stored."""
        if self.version() not in (None, SCHEMA_VERSION):
            raise StoreVersion(self.version())
        if self.table("session").isEmpty():
            raise StoreEmpty(self.path)

    def drop_all(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def commit(self, tables: dict[str, tuple[DataFrame, list[int]]], notes: dict[str, Any] | None = None) -> None:
        """Replaces parts of tables: (all rows of these parts, the parts) of each; notes are kept with the pointer.

        The write itself counts and sums up the rows of each part, for integrity.
        """
        pointers = self._pointers()
        state, name = self._state(), f"snapshot-{uuid.uuid4().hex}"
        before, marks = state["places"], dict(state["marks"])
        after = {t: dict(before[t]) for t in SCHEMAS}
        fs, path = self._fs()

        def write(t: str) -> None:
            df, parts = tables[t]
            rows = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMAS[t].split(", ")], part_of(KEYS[t]))
            seen = Observation()
            own = [F.struct(F.count_if(F.col("part") == k).alias("n"), checksum(t, F.col("part") == k).alias("sum")).alias(f"p{k}") for k in parts]
            rows.repartition("part").observe(seen, F.count("*").alias("rows"), *own).write.partitionBy("part").parquet(f"{self.path}/{name}/{t}")
            found = seen.get
            for k in parts:
                folder = f"{name}/{t}/part={k}"
                after[t].pop(str(k), None)
                if found[f"p{k}"]["n"]:
                    after[t][str(k)] = folder
                    marks[folder] = {"rows": found[f"p{k}"]["n"], "sum": str(found[f"p{k}"]["sum"]), "files": self._files(folder)}

        with ThreadPoolExecutor(max(1, len(tables))) as pool:  # the tables are independent jobs
            list(pool.map(write, tables))
        if self.version() is None:
            self._write_text("VERSION", SCHEMA_VERSION)
        self._write_text(f"POINTER-{int(pointers[-1].split('-')[1]) + 1 if pointers else 0:09d}", json.dumps({"places": after, "marks": {f: marks[f] for t in SCHEMAS for f in after[t].values()}, "notes": state["notes"] | (notes or {})}))
        # readers of the state before may go on; what only older states hold goes
        held = {f for places in (before, after) for parts_ in places.values() for f in parts_.values()}
        for old in pointers[:-1]:
            for parts_ in self._places(old).values():
                for f in set(parts_.values()) - held:
                    fs.delete(path(f"{self.path}/{f}"), True)
            fs.delete(path(f"{self.path}/{old}"), False)

    def ingest(self, sources: list[tuple[Source, str]], full: bool = False, home: str | None = None) -> DataFrame:
        """Ingests changed files of (source, root); returns counts (source, status, n).

        A file that can't be read counts as error and keeps what it gave
        before; the others go on.  Changed lines are read and put in order
        once, into a staged table that all three tables come from.
        """
        if full:
            self.drop_all()
        counts: list[tuple[str, str, int]] = []
        held: list[DataFrame] = []
        new: dict[str, DataFrame | None] = {t: None for t in SCHEMAS}
        changed_files = None
        staged = f"{self.path}/.staged-{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return df

        def add(t: str, df: DataFrame) -> None:
            new[t] = df if new[t] is None else new[t].unionByName(df)

        def count(name: str, df: DataFrame) -> dict[str, int]:
            rows = df.groupBy("status").agg(F.count("*").alias("n"), F.max("file_size").alias("largest")).collect()
            counts.extend((name, r["status"], r["n"]) for r in rows if r["status"] != "check")
            return {r["status"]: (r["n"], r["largest"]) for r in rows}

        def names(df: DataFrame, n: int) -> DataFrame | list[str]:
            """Few files by name, which a scan opens alone; many as a table."""
            return [r["file_path"] for r in df.select("file_path").collect()] if n <= jsonl.MOST_NAMED else df

        old_manifest = self.table("manifest")
        for k, (source, root) in enumerate(sources):
            listing = keep(diff(jsonl.files(self.spark, root), old_manifest))
            n, largest = count(source.name, listing).get("check", (0, 0))
            if not n:
                continue
            check = listing.filter("status = 'check'").drop("status")
            found = jsonl.hashes(self.spark, root, chosen=names(check, n), largest=largest)
            check = keep(check.join(found, "file_path", "left"))
            fresh = check.filter("content_hash is not null and (old_hash is null or content_hash <> old_hash)").select("file_path", "old_id")
            chosen = names(fresh, n)
            filled = None
            if chosen:
                lines = source.normalise(jsonl.read_lines(self.spark, root, chosen=chosen))
                rows = sessions.sequenced(lines, sessions.SEGMENT if largest > LARGE_FILE else None)
                rows.write.option("compression", "zstd").parquet(f"{staged}/{k}")
                t = sessions.tables(self.spark.read.schema(rows.schema).parquet(f"{staged}/{k}"), source.name, source.prefix, home, keep)
                filled = t.session.select("file_path", F.col("id").alias("session_id"))
                changed_files = fresh if changed_files is None else changed_files.union(fresh)
                add("session", t.session.withColumn("ingested_at", F.current_timestamp()))
                add("message", t.message)
                add("tool_call", t.tool_call)
            state = keep(decided(check, filled))
            count(source.name, state)
            add("manifest", state.filter("status <> 'error'").select("file_path", "file_mtime", "file_size", "content_hash", "session_id"))
        if new["manifest"] is not None:
            self._replace(new, changed_files, held)
        for x in held:  # else a later listing of the same folders would be read from the cache
            x.unpersist()
        fs, path = self._fs()
        fs.delete(path(staged), True)
        return self.spark.createDataFrame(counts, "source string, status string, n long")

    def _replace(self, new: dict[str, DataFrame | None], changed: DataFrame | None, held: list[DataFrame]) -> None:
        """Writes the parts that new rows or deleted sessions touch."""
        files = new["manifest"].select("file_path")
        touched = files.select(F.lit("manifest").alias("of"), part_of("file_path"))
        gone = None
        if changed is not None:
            # what a changed file gave before goes, whatever it gives now; and what has a new session's id
            gone = changed.select(F.col("old_id").alias("id")).filter("id is not null").union(new["session"].select("id")).distinct().persist()
            held.append(gone)
            touched = touched.union(gone.select(F.lit("session"), part_of("id")))
        parts: dict[str, list[int]] = {"manifest": [], "session": []}
        for r in touched.distinct().collect():
            parts[r["of"]].append(r["part"])
        rest = self.table("manifest", parts["manifest"]).join(files, "file_path", "left_anti")
        tables = {"manifest": (rest.unionByName(new["manifest"]), parts["manifest"])}
        if gone is not None:
            session = surviving(new["session"], changed).persist()
            held.append(session)
            winners = session.select("file_path")
            for t in ("session", "message", "tool_call"):
                rest = self.table(t, parts["session"]).join(gone.withColumnRenamed("id", KEYS[t]), KEYS[t], "left_anti")
                own = session if t == "session" else new[t].join(winners, "file_path", "left_semi").drop("file_path")
                tables[t] = (rest.unionByName(own), parts["session"])
        self.commit(tables)

    def append(self, new: Tables, notes: dict[str, Any]) -> None:
        """Adds further messages and tool calls of sessions and puts their newest rows in place of older ones.

        A file whose session id has changed takes what it gave before along.
        The notes are kept by the same commit.
        """
        session = new.session.withColumn("ingested_at", F.current_timestamp()).persist()
        files = session.select("file_path", F.col("id").alias("session_id"))
        known = self.table("manifest").join(files.select("file_path"), "file_path", "left_semi").select("file_path", F.col("session_id").alias("old_id"))
        moved = files.join(known, "file_path").filter("old_id <> session_id").select("old_id", F.col("session_id").alias("new_id")).persist()
        keys = files.select(F.lit("manifest").alias("of"), part_of("file_path")).union(files.select(F.lit("session"), part_of("session_id"))).union(moved.select(F.lit("session"), part_of("old_id")))
        parts: dict[str, list[int]] = {"manifest": [], "session": []}
        for r in keys.distinct().collect():
            parts[r["of"]].append(r["part"])
        stamps = files.select("file_path", F.lit(None).cast("timestamp").alias("file_mtime"), F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("string").alias("content_hash"), "session_id")
        rest = self.table("manifest", parts["manifest"]).join(files.select("file_path"), "file_path", "left_anti")
        tables = {"manifest": (rest.unionByName(stamps), parts["manifest"])}
        gone = session.select("id").union(moved.select("old_id"))
        tables["session"] = (self.table("session", parts["session"]).join(gone, "id", "left_anti").unionByName(session), parts["session"])
        for t, df in (("message", new.message), ("tool_call", new.tool_call)):
            held = self.table(t, parts["session"]).join(F.broadcast(moved) if moved.count() <= 10_000 else moved, F.col("session_id") == F.col("old_id"), "left")
            held = held.withColumn("session_id", F.coalesce("new_id", "session_id")).drop("old_id", "new_id")
            tables[t] = (held.unionByName(df.drop("file_path")), parts["session"])
        self.commit(tables, notes)
        session.unpersist()
        moved.unpersist()

    def stats(self) -> dict[str, Any]:
        """Sessions by source and kind, and the real ones."""
        rows = self.table("session").groupBy("source", "kind").agg(F.count("*").alias("n")).collect()
        counts: dict[str, dict[str, int]] = {}
        for r in sorted(rows, key=lambda r: (r["source"], r["kind"])):
            counts.setdefault(r["source"], {})[r["kind"]] = r["n"]
        return {"sessions_by_source_kind": counts, "real": {s: k.get("real", 0) for s, k in counts.items()}}

    def last_ingest(self) -> str | None:
        last = self.table("session").agg(F.max("ingested_at")).first()[0]
        return str(last) if last is not None else None

    def broken(self, deep: bool = False) -> list[str]:
        """Folders of parts whose rows aren't those that were written.

        A part whose files have the lengths and times that they were written
        with is taken for whole, unless ``deep``; of others all rows are read,
        counted and summed up.
        """
        state, out = self._state(), []
        for t in SCHEMAS:
            for folder in state["places"][t].values():
                mark = state["marks"][folder]
                if not deep and self._files(folder) == mark["files"]:
                    continue
                try:
                    n, total = self.spark.read.schema(SCHEMAS[t]).parquet(f"{self.path}/{folder}").agg(F.count("*"), checksum(t)).first()
                except Exception:  # whatever a broken file raises
                    n, total = None, None
                if (n, str(total)) != (mark["rows"], mark["sum"]):
                    out.append(folder)
        return sorted(out)

    def integrity(self, deep: bool = False) -> str:
        """ok, or the parts that differ from what was written."""
        found = self.broken(deep)
        return "ok" if not found else "broken: " + ", ".join(found)

    def size_kb(self) -> float:
        fs, path = self._fs()
        return round(fs.getContentSummary(path(self.path)).getLength() / 1024, 1) if fs.exists(path(self.path)) else 0.0

    def health(self, deep: bool = False) -> dict[str, Any]:
        """Integrity, files tracked, messages without a session, and advice."""
        sound = self.integrity(deep)
        if sound != "ok":
            return {"status": "degraded", "integrity": sound, "sessions": 0, "files_tracked": 0, "orphan_messages": 0, "store_kb": self.size_kb(), "version": self.version(), "advice": ["ingest --full (integrity)"]}
        lost = orphans(self.table("message"), self.table("session").select(F.col("id").alias("session_id"))).count()
        healthy = lost == 0 and self.version() in (None, SCHEMA_VERSION)
        return {
            "status": "healthy" if healthy else "degraded", "integrity": sound, "sessions": self.table("session").count(), "files_tracked": self.table("manifest").count(),
            "orphan_messages": lost, "store_kb": self.size_kb(), "version": self.version(), "advice": [] if healthy else ["ingest --full"],
        }


def orphans(children: DataFrame, parents: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of children without a parent."""
    return children.join(parents.select(key), key, "left_anti")
