"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the whole problem is a
histogram of at most ``capacity`` counts, whatever the number of documents;
the driver plans on that histogram alone.

1. Large lengths, sorted, are dealt into groups of equal cardinality, and each
   is rounded up to the longest of its group.
2. The few rounded lengths give a configuration programme: how many sequences
   of each filling pattern cover all items with the fewest sequences.  Column
   generation solves its relaxation; counts are rounded down.
3. Actual lengths take the places of the rounded ones, longest first.
4. Items left over and small ones go by best fit, longest first, into the
   space that is left.

The plan consists of runs: the documents of one length with ranks lo to hi - 1
go to consecutive sequences at one offset.  A document finds its place by its
length and its rank among the documents of that length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.bpe import IdCache, load
from logloom.llm.shared import bound_batches, write_shared

GROUPS = 96
SMALL = 8  # lengths up to capacity / SMALL go by best fit alone
ROUNDS = 2000


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and multiplicities of an optimal relaxed cover of counts items of each size."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amount = counts / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(ROUNDS):
        value = inverse.sum(axis=0)  # duals: every pattern costs one sequence
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for g in np.flatnonzero(value > 1e-12):
            s = sizes[g]
            for _ in range(capacity // s):
                better = best[:-s] + value[g] > best[s:] + 1e-12
                if not better.any():
                    break
                lower = best[:-s] + value[g]
                best[s:][better] = lower[better]
                choice[s:][better] = g
        if best[capacity] <= 1 + 1e-9:
            break
        pattern, left = np.zeros(n), capacity
        while left > 0 and choice[left] >= 0:
            pattern[choice[left]] += 1
            left -= sizes[choice[left]]
        if pattern @ value <= 1 + 1e-9 or pattern @ sizes > capacity:
            break
        step = inverse @ pattern
        can = step > 1e-9
        if not can.any():
            break
        ratio = np.full(n, np.inf)
        ratio[can] = amount[can] / step[can]
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = pattern
    return [(basis[:, i].astype(int), amount[i]) for i in range(n) if amount[i] > 0]


class Plan:
    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> (first sequence, count)

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, size: int, lo: int, n: int, sequence: int, offset: int) -> None:
        if n:
            self.runs.append((size, lo, lo + n, sequence, offset))

    def best_fit(self, size: int, lo: int, n: int) -> None:
        while n:
            space = next((s for s in range(size, self.capacity) if self.open[s]), None)
            if space is None:
                break
            first, k = self.open[space].pop()
            take = min(k, n)
            if take < k:
                self.open[space].append((first + take, k - take))
            self.put(size, lo, take, first, self.capacity - space)
            self.open[space - size].append((first, take))
            lo, n = lo + take, n - take
        each = self.capacity // size
        if n >= each:
            k = n // each
            first = self.new(k)
            for j in range(each):
                self.put(size, lo, k, first, j * size)
                lo += k
            self.open[self.capacity - each * size].append((first, k))
            n -= each * k
        if n:
            first = self.new(1)
            for j in range(n):
                self.put(size, lo + j, 1, first, j * size)
            self.open[self.capacity - n * size].append((first, 1))


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, lo, hi, first sequence, offset) that place every item of the histogram."""
    p = Plan(capacity)
    if full := histogram.get(capacity, 0):
        p.put(capacity, 0, full, p.new(full), 0)
    lengths = sorted((s for s, n in histogram.items() if n and s < capacity), reverse=True)
    large = [s for s in lengths if s > capacity // SMALL]
    total = sum(histogram[s] for s in large)
    left: dict[int, list[list[int]]] = defaultdict(list)  # length -> [first rank, count]
    if total:
        each = -(-total // min(groups, total))
        queues: list[list[list[int]]] = []  # of a group: [length, first rank, count]
        room = 0
        for s in large:
            lo, n = 0, histogram[s]
            while n:
                if not room:
                    queues.append([])
                    room = each
                take = min(room, n)
                queues[-1].append([s, lo, take])
                lo, n, room = lo + take, n - take, room - take
        sizes = np.array([q[0][0] for q in queues])
        counts = np.array([sum(x[2] for x in q) for q in queues])
        for pattern, amount in configurations(sizes, counts.astype(float), capacity):
            slots = [g for g in np.argsort(-sizes, kind="stable") for _ in range(pattern[g])]
            held = [sum(x[2] for x in queues[g]) for g in range(len(queues))]
            m = min([int(amount + 1e-9), *(held[g] // int(pattern[g]) for g in set(slots))])
            if not m or not slots:
                continue
            taken = []  # for each slot the runs that fill it in the m sequences
            for g in slots:
                need, runs = m, []
                while need:
                    x = queues[g][0]
                    k = min(need, x[2])
                    runs.append([x[0], x[1], k])
                    x[1], x[2], need = x[1] + k, x[2] - k, need - k
                    if not x[2]:
                        queues[g].pop(0)
                taken.append(runs)
            first = p.new(m)
            while m:
                k, offset = min(runs[0][2] for runs in taken), 0
                for runs in taken:
                    s, lo, _ = runs[0]
                    p.put(s, lo, k, first, offset)
                    offset += s
                    runs[0][1], runs[0][2] = lo + k, runs[0][2] - k
                    if not runs[0][2]:
                        runs.pop(0)
                p.open[capacity - offset].append((first, k))
                first, m = first + k, m - k
        for q in queues:
            for s, lo, n in q:
                left[s].append([lo, n])
    for s in lengths:
        for lo, n in left[s] if s > capacity // SMALL else [[0, histogram[s]]]:
            p.best_fit(s, lo, n)
    return p.runs


def _pieces(spec, capacity, end):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = load(spec, IdCache), np.zeros(capacity + 1, dtype=np.int64)
        task, last = TaskContext.get().partitionId(), end.to_bytes(4, "little")
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = cache.encode(text or "") + last
                n = len(ids) // 4
                start, view = 0, memoryview(ids)
                length = n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    for x, v in zip(out, (doc_id, piece, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), int(seen[length])), strict=True):
                        x.append(v)
                    seen[length] += 1
                    start, piece, length = start + length, piece + 1, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(x, t) for x, t in zip(out, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())], names)

    return run


def pack(documents: DataFrame, vocabulary_path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the id ``end``; a null text is empty, so every
    row gives a piece.  Documents over the capacity are cut into pieces of
    that length, of which the first may be shorter.  Repeated rows are packed
    once each; other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = write_shared(docs.mapInArrow(_pieces(spec, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"))
    by_task = pieces.groupBy("length", "task").count()
    # at most `capacity` rows reach the driver
    histogram = {r["length"]: r["sum(count)"] for r in by_task.groupBy("length").sum("count").collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), "p_length long, lo long, hi long, first long, offset long")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.col("rank")
    return (
        pieces.join(starts, ["length", "task"])
        .withColumn("rank", place)
        .join(F.broadcast(runs), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
    )
