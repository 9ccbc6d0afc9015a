"""Exact substring removal with a logarithmic family of suffix arrays.

Suffixes are indexed at anchors: of every WINDOW consecutive byte positions
the one whose 16-byte hash is least (leftmost of equals).  Equal strings of
``length`` bytes have their first anchor at the same place, and share at least
``length - WINDOW`` bytes from there, so the order of suffixes needs to tell
apart only that many bytes.  They are ordered by 128 bits of these bytes
instead of the alphabet, which puts those with long matches side by side as
well, and lets an array be cut into buckets that need no common range.

* A new batch of texts gets its suffix array: its anchored suffixes, sorted,
  in buckets, in a folder of the index.
* It is merge-scanned against each level (a sort-merge join of sorted buckets,
  without a shuffle); suffixes that meet others there, or in the batch, match.
* The batch becomes a level of rank 0; two levels of one rank are merged into
  one of the next, so that n batches leave at most log2(n) + 1 levels.
* A manifest beside the levels names them; an index can be opened again, in
  another session, and go on with further batches.

Matching suffixes are resolved to bytes.  Every anchor stands for a run of
string starts.  Runs with equal bytes repeat as a whole.  Where runs of
matching suffixes differ, the strings at each alignment are compared, and
equal neighbours repeat.

Texts that occur more than once are removed whole; one copy in each task goes
into the index for the texts that share a part with it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.jaccard import runs_of
from logloom.llm.shared import Folder, bound_batches, checked, delete, release

WINDOW = 200
GRAM = 16
BATCHES = 4
#: Runs of one prefix that a task resolves together; more are split by the strings' hashes.
GROUP = 20_000
#: Bytes whose anchors are chosen at a time, and the bits of a position among them (with a string's length more).
SPAN, POSITION = 1 << 19, np.uint64(22)
#: Texts that a task remembers as indexed.
SEEN = 200_000

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xC2B2AE3D27D4EB4F)


def text_key() -> list[Column]:
    """128 bits that stand for a text (column text, binary)."""
    return [F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64("text", F.lit(2)).alias("t2")]


def anchors(data: bytes, starts: np.ndarray) -> np.ndarray:
    """For each start of a string (its window lies within data) the anchor's position."""
    n = len(data)
    padded = np.frombuffer(data + bytes(GRAM), np.uint8)
    words = np.empty(n + 8, np.uint64)
    for shift in range(8):
        part = padded[shift : shift + (len(padded) - shift) // 8 * 8].view("<u8")
        own = words[shift::8]
        m = min(len(own), len(part))
        own[:m] = part[:m]
    h = (words[:n] ^ (words[8 : n + 8] * _M)) * _N
    h ^= h >> np.uint64(29)
    h *= _M
    # always as many bits, whatever the span: the choice depends on the window's bytes alone
    h = (h >> POSITION << POSITION) | np.arange(n, dtype=np.uint64)
    blocks = -(-(n + WINDOW) // WINDOW)
    grid = np.full(blocks * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = h
    grid = grid.reshape(blocks, WINDOW)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    least = np.minimum(ahead[starts], behind[starts + WINDOW - 1])
    return (least & ((np.uint64(1) << POSITION) - np.uint64(1))).astype(np.int64)


def runs(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, anchor, first start, last start) of each run, positions within the text; a run may end where a span ends."""
    for span in _spans(texts, length):
        data = b"".join(texts[i][a:z] for i, a, z in span)
        text, offset, stop = (np.array(x) for x in zip(*span, strict=True))
        sizes = stop - offset
        base = np.cumsum(sizes) - sizes
        number = sizes - length + 1
        owner = np.repeat(np.arange(len(span)), number)
        starts = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + base[owner]
        at = anchors(data, starts)
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[first[1:], len(at)] - 1
        own = owner[first]
        off = base[own] - offset[own]
        yield from zip(text[own].tolist(), (at[first] - off).tolist(), (starts[first] - off).tolist(), (starts[last] - off).tolist(), strict=True)


def _spans(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) of about SPAN bytes; parts of one text overlap by length - 1, so that each start is in one."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - length + 1), SPAN):
            held.append((i, a, min(len(t), a + SPAN + length - 1)))
            size += held[-1][2] - a
            if size >= SPAN:
                yield held
                held, size = [], 0
    if held:
        yield held


#: A suffix: 128 bits of its first bytes, 64 of the whole run, the text, the anchor and the first and last start of the run.
ENTRY = "p1 long, p2 long, whole long, t1 long, t2 long, at int, lo int, hi int"


def _entries(length):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        h64, h128 = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for b in batches:
            keys = list(zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), strict=True))
            texts = []
            for k, t in zip(keys, b.column("text").to_pylist(), strict=True):
                texts.append(b"" if k in seen else t)
                seen.add(k)
            if len(seen) > SEEN:
                seen.clear()
            prefix, whole, of, at, lo, hi = [], [], [], [], [], []
            for i, a, p, q in runs(texts, length):
                t = texts[i]
                prefix.append(h128(t[a : a + length - WINDOW]))
                whole.append(h64(t[p : q + length], a - p))
                of.append(i)
                at.append(a)
                lo.append(p)
                hi.append(q)
            p12 = np.frombuffer(b"".join(prefix), "<i8").reshape(-1, 2)
            t12 = np.array(keys, dtype=np.int64).reshape(-1, 2)[np.array(of, dtype=np.int64)]
            longs = [p12[:, 0], p12[:, 1], np.array(whole, np.uint64).view(np.int64), t12[:, 0], t12[:, 1]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in longs), *(pa.array(x, pa.int32()) for x in (at, lo, hi))], ["p1", "p2", "whole", "t1", "t2", "at", "lo", "hi"])

    return run


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """The anchored suffixes of docs(t1, t2, text)."""
    return docs.select("t1", "t2", "text").mapInArrow(_entries(length), ENTRY)


class LogIndex:
    """A family of suffix arrays in a folder; a level of rank r holds 2**r batches.

    Levels are tables of ENTRY in ``buckets`` buckets by (p1, p2), sorted
    in each.  ``manifest-N`` lists what belongs to the index after N batches;
    the one with the highest N counts, so that a batch that failed half-way
    leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.state = self._newest() or {"batches": 0, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": {}, "hits": []}

    def _newest(self) -> dict | None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        done = [n for n in names if n.startswith("manifest-") and files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return json.loads(self.spark.read.text(f"{self.path}/{max(done)}").first()[0]) if done else None

    def _write(self, rows: DataFrame, order: list[str]) -> str:
        name = f"part_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        writer.bucketBy(self.state["buckets"], "p1", "p2").sortBy(*order).saveAsTable(f"loom_{name}")
        release(self.spark)
        return name

    def _read(self, name: str, columns: str) -> DataFrame:
        if not self.spark.catalog.tableExists(f"loom_{name}"):
            self.spark.sql(f"CREATE TABLE loom_{name} ({columns}) USING parquet CLUSTERED BY (p1, p2) SORTED BY (p1, p2) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(f"loom_{name}")

    def _forget(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS loom_{n}")
            delete(self.spark, f"{self.path}/{n}")

    @property
    def levels(self) -> dict[int, DataFrame]:
        return {int(rank): self._read(name, ENTRY) for rank, name in self.state["levels"].items()}

    def add(self, entries: DataFrame) -> DataFrame:
        """Indexes a batch of suffixes and returns those first bytes (p1, p2) of it that match others in it or in a level."""
        state = json.loads(json.dumps(self.state))
        own = self._write(entries.repartition(state["buckets"], "p1", "p2"), ["p1", "p2"])
        array = self._read(own, ENTRY)
        heads = array.groupBy("p1", "p2").agg(F.count("*").alias("n"))
        found = heads.filter("n > 1").select("p1", "p2")
        for level in self.levels.values():
            met = array.select("p1", "p2").hint("merge").join(level.select("p1", "p2"), ["p1", "p2"], "left_semi")
            found = found.union(met)
        hits = self._write(found.distinct().repartition(state["buckets"], "p1", "p2"), ["p1", "p2"])
        old, rank, merged = [], 0, [own]
        while str(rank) in state["levels"]:
            merged.append(state["levels"].pop(str(rank)))
            rank += 1
        if rank:
            old = merged
            level = self._read(own, ENTRY)
            for name in merged[1:]:
                level = level.union(self._read(name, ENTRY))
            own = self._write(level, ["p1", "p2"])
        state["levels"][str(rank)] = own
        state["hits"].append(hits)
        state["batches"] += 1
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{state['batches']:09d}")
        self.state = state
        self._forget(old)
        return self._read(hits, "p1 long, p2 long")

    def matches(self) -> DataFrame:
        """The suffixes of all levels that match another one."""
        hits = None
        for name in self.state["hits"]:
            own = self._read(name, "p1 long, p2 long")
            hits = own if hits is None else hits.union(own)
        out = None
        for level in self.levels.values():
            part = level.join(hits.distinct(), ["p1", "p2"], "left_semi")
            out = part if out is None else out.union(part)
        return out

    def drop(self) -> None:
        """Deletes the index."""
        self._forget([*self.state["levels"].values(), *self.state["hits"]])
        delete(self.spark, self.path)


def repeats(rows: list[tuple[bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each (bytes from the first start, anchor - first start, starts) the ranges of starts that another row repeats.

    At each alignment to the anchor the strings are sorted; equal neighbours repeat.
    """
    marks: list[list[int]] = [[] for _ in rows]
    deepest = max(a for _, a, _ in rows)
    shallow = min(a - n + 1 for _, a, n in rows)
    for left in range(shallow, deepest + 1):
        cut = sorted((t[a - left : a - left + length], i) for i, (t, a, n) in enumerate(rows) if 0 <= a - left < n)
        last = None
        for s, i in cut:
            if last is not None and s == last[0]:
                for j in (last[1], i):
                    p = rows[j][1] - left
                    if not marks[j] or marks[j][-1] != p:
                        marks[j].append(p)
            last = (s, i)
    out = []
    for own in marks:
        ranges: list[tuple[int, int]] = []
        for p in sorted(set(own)):
            if ranges and ranges[-1][1] == p:
                ranges[-1] = (ranges[-1][0], p + 1)
            else:
                ranges.append((p, p + 1))
        out.append(ranges)
    return out


def _resolve(length):
    names = ["t1", "t2", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches, ["p1", "p2"]):
            lo, at, hi = (t.column(c).to_pylist() for c in ("lo", "at", "hi"))
            context = t.column("context").to_pylist()
            found = repeats([(x, a - p, q - p + 1) for x, a, p, q in zip(context, at, lo, hi, strict=True)], length)
            rows = [(x, y, p + a, p + b - 1 + length) for x, y, p, own in zip(t.column("t1").to_pylist(), t.column("t2").to_pylist(), lo, found, strict=True) for a, b in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)

    return run


def _contexts(length):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, wanted = b.column("text").to_pylist(), b.column("wanted").to_pylist()
            rows = [(x, y, w["p1"], w["p2"], w["classes"], w["at"], w["lo"], w["hi"], t[w["lo"] : w["hi"] + length]) for x, y, t, ws in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), text, wanted, strict=True) for w in ws]
            kinds = [*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary()]
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], ["t1", "t2", "p1", "p2", "classes", "at", "lo", "hi", "context"])

    return run


def _strings(length):
    """Hashes of all strings of the runs of very large groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64 = xxhash.xxh3_64_intdigest
        for b in batches:
            for x, y, p, q, c in zip(*(b.column(n).to_pylist() for n in ("t1", "t2", "lo", "hi", "context")), strict=True):
                n = q - p + 1
                h = np.array([(h64(s), h64(s, 1)) for s in (c[i : i + length] for i in range(n))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(n, x)), pa.array(np.full(n, y)), pa.array(np.arange(p, q + 1))], ["h1", "h2", "t1", "t2", "start"])

    return run


def _cut():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, sha, size = [], [], [], []
            for text, copies, own in zip(b.column("text").to_pylist(), b.column("whole").to_pylist(), b.column("spans").to_pylist(), strict=True):
                n = len(text)
                if copies:
                    own = [{"start": 0, "stop": n}]
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["stop"]) for s in own or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, last = hashlib.sha256(), 0
                for a, z in merged:
                    kept.update(memoryview(text)[last:a])
                    last = z
                kept.update(memoryview(text)[last:])
                size.append(n)
                removed.append(sum(z - a for a, z in merged))
                spans.append(len(merged))
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_spans(matches: DataFrame, docs: DataFrame, length: int, folder: Folder) -> DataFrame:
    """(t1, t2, start, stop) of byte ranges of the texts docs(t1, t2, text) that strings occurring elsewhere cover; may overlap."""
    same = ["p1", "p2"]
    shared = folder.write(matches)
    one = F.first(F.struct("t1", "t2", "at", "lo", "hi")).alias("one")
    classes = folder.write(shared.groupBy(*same, "whole").agg(F.count("*").alias("n"), one))
    full = shared.join(classes.filter("n > 1").select(*same, "whole"), [*same, "whole"], "left_semi")
    spans = folder.write(full.select("t1", "t2", F.col("lo").cast("long").alias("start"), (F.col("hi").cast("long") + length).alias("stop")))
    folder.drop(shared)

    several = classes.groupBy(*same).agg(F.count("*").alias("classes")).filter("classes > 1")
    wanted = classes.join(several, same).select("one.t1", "one.t2", F.struct(*same, "classes", "one.at", "one.lo", "one.hi").alias("w"))
    wanted = folder.write(wanted.groupBy("t1", "t2").agg(F.collect_list("w").alias("wanted")))
    folder.drop(classes)
    # of a text that occurs more than once one copy is read on
    texts = docs.join(checked(wanted.select("t1", "t2")), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    contexts = texts.join(wanted, ["t1", "t2"]).mapInArrow(_contexts(length), "t1 long, t2 long, p1 long, p2 long, classes long, at int, lo int, hi int, context binary")
    contexts = folder.write(contexts)
    folder.drop(wanted)
    small = contexts.filter(F.col("classes") <= GROUP).repartition(*same).sortWithinPartitions(*same)
    spans = spans.union(folder.write(small.mapInArrow(_resolve(length), "t1 long, t2 long, start long, stop long")))
    strings = contexts.filter(F.col("classes") > GROUP).mapInArrow(_strings(length), "h1 long, h2 long, t1 long, t2 long, start long")
    again = strings.groupBy("h1", "h2").count().filter("count > 1")
    large = folder.write(strings.join(again, ["h1", "h2"], "left_semi").select("t1", "t2", "start", (F.col("start") + length).alias("stop")))
    folder.drop(contexts)
    return spans.union(large)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, t1, t2, text (binary, empty for null) of each row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return docs.select("doc_id", *text_key(), "text")


def remove_repeats(documents: DataFrame, length: int = 400, batches: int = BATCHES) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else too, in the same text or another.  A null text is empty; texts
    shorter than ``length`` lose nothing; other columns are ignored; repeated
    rows are copies of one another; an empty table gives no rows.  A very long
    text is indexed a span at a time; it is held whole a few times over.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs, folder = keyed(documents), Folder(spark)
    index = LogIndex(spark, f"{folder.base}/index")
    for k in range(batches):
        index.add(suffixes(docs.filter(F.pmod(F.xxhash64("t1", F.lit(3)), F.lit(batches)) == k), length))
    spans = repeated_spans(index.matches(), docs, length, folder)
    index.drop()

    # a text with a copy goes whole, so that only texts that occur once need their spans
    copies = docs.filter(F.octet_length("text") >= length).groupBy("t1", "t2").count().filter("count > 1").select("t1", "t2", F.lit(True).alias("whole"))
    copies = folder.write(copies)
    own = spans.join(checked(copies.select("t1", "t2")), ["t1", "t2"], "left_anti")
    marks = folder.write(own.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    keys = checked(marks.select("t1", "t2"))
    none = F.lit(None).cast("array<struct<start: bigint, stop: bigint>>").alias("spans")
    untouched = docs.join(keys, ["t1", "t2"], "left_anti").join(checked(copies), ["t1", "t2"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), none)
    touched = docs.join(keys, ["t1", "t2"], "left_semi").join(marks, ["t1", "t2"]).select("doc_id", "text", F.lit(False).alias("whole"), "spans")
    return untouched.union(touched).mapInArrow(_cut(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
