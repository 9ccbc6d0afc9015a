"""N-gram Jaccard join with PartEnum signatures.

A document is its set of distinct word shingles.  Sets are put into size
bands such that similar sets lie in one band or in two neighbouring ones; an
instance joins a band with the one below.  Similar sets of an instance differ
in at most k elements.  The feature domain is cut into first-level partitions,
ceil((k + 1) / 3) of them, in one of which similar sets differ in at most two
elements; that one is cut into four second-level partitions, and the subsets
that leave out two of them are enumerated.  A signature is a hash of the set's
features in one such subset, so similar sets share a signature.

1. One pass over the texts makes the signatures.  They travel packed, seven
   bytes each, to buckets of bounded size, where equal ones are brought
   together; only the members of groups of two or more leave their bucket.
2. Equal sets count once.  Each set is compared with the first of each of its
   groups; what is similar forms components.
3. Groups that still hold sets of several components are searched for pairs
   between components that may be similar, by size and by sketch: the bits in
   which parity sketches differ are a lower bound of the sets' difference, and
   a close one.  A first search takes of each group only pairs that join its
   parts; a second one all that are left between what is still apart.
4. Pairs are dealt by their first set, which is sent once for a block of
   partners.  The sets themselves, made again from one text each, decide.

Everything but step 1 moves only numbers of sets, sketches of sets in mixed
groups, and sets that are paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.shared import Folder, bound_batches, checked, once

WORD_CACHE = 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _N
    x = x ^ (x >> np.uint64(29))
    x = x * _M
    return x ^ (x >> np.uint64(32))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_sets(texts: list[bytes | None], size: int, cache: WordHash) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; one for the whole of a text with fewer words."""
    words = [t.translate(_LOWER).split() if t else [] for t in texts]
    flat = np.fromiter((cache[w] for ws in words for w in ws), np.uint64, sum(map(len, words)))
    n = len(flat)
    grams = np.full(max(0, n - size + 1), size, np.uint64)
    for i in range(size):
        grams = mix(grams * _M + flat[i : i + len(grams)])
    out, at = [], 0
    for ws in words:
        k = len(ws)
        if k >= size:
            out.append(np.unique(grams[at : at + k - size + 1]))
        elif k:
            h = np.full(1, k, np.uint64)
            for w in flat[at : at + k]:
                h = mix(h * _M + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


#: Second-level partitions, and how many of them a subset leaves out.
SECOND, LEFT_OUT = 4, 2
#: Signatures that a bucket is meant to hold, and that a task holds before it deals them out.
BUCKET, HELD = 1 << 20, 1 << 20
#: Signatures for a byte of text, at most about (for the number of buckets only).
DENSITY = 0.3
#: Members of a signature group that one task compares with as many others; partners of a set in one block.
BLOCK = 1500
#: Pairs of sets that are verified in one round, at least.
PAIRS = 20_000
#: Sets that a task remembers, so as to give their signatures once.
SEEN = 200_000


class Bands:
    """Size bands for the threshold num / den, and the partitions of each instance."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1], self.low[-1] * self.den // self.num) + 1)
        lo, hi = 0, len(self.low) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.low[mid] <= n else (lo, mid)
        return lo

    def differ(self, total: int) -> int:
        """Most elements in which similar sets of this total size differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def partitions(self, instance: int) -> tuple[int, int, int]:
        """First-level partitions, second-level ones in each, and how many of these a subset leaves out."""
        while len(self.low) <= instance + 1:
            self.of(self.low[-1])
        k = self.differ(2 * (self.low[instance + 1] - 1))
        out = min(k, LEFT_OUT)
        return k // (out + 1) + 1, SECOND - LEFT_OUT + out if k else 1, out


def subsets(second: int, out: int) -> np.ndarray:
    """One column of zeros and ones for each subset of the second-level partitions that leaves some out."""
    table = np.zeros((second, 0), np.uint64)
    for kept in combinations(range(second), second - out):
        table = np.column_stack([table, np.isin(np.arange(second), kept).astype(np.uint64)])
    return table


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """64-bit signatures of one set in the two instances of its band."""
    if not len(s):
        return np.zeros(0, np.uint64)
    own = bands.of(len(s))
    made = []
    for instance in (own, own + 1):
        first, second, out = bands.partitions(instance)
        cells = first * second
        cell = ((s >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        value = mix(s + np.uint64(instance))
        # s is sorted, and so are the cells: sums of runs
        edges = np.searchsorted(cell, np.arange(cells + 1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        kept = (sums[edges[1:]] - sums[edges[:-1]]).reshape(first, second) @ subsets(second, out)
        tag = np.arange(kept.size, dtype=np.uint64).reshape(kept.shape) + np.uint64(instance << 32)
        made.append(mix(kept + mix(tag * _M)).ravel())
    return np.concatenate(made)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of features in cells by their low bits; two cells or more for a feature, a power of two, 64 at least."""
    cells = max(64, 1 << (2 * len(s) - 1).bit_length() if len(s) else 64)
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer cells that a sketch (64-bit words) implies."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    a, b = mix(s).sum() + np.uint64(len(s)), mix(s * _N + _M).sum()
    return tuple(mix(np.array([a, b])).view(np.int64).tolist())


def dealt(held: list[np.ndarray], buckets: int, base: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, base, low five bytes of each signature, number of its set from base on)."""
    flat = np.concatenate(held)
    own = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
    order = np.argsort(flat)
    flat, own = flat[order], own[order]
    bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    low = np.ascontiguousarray(flat.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(flat) else np.zeros(0, np.int64)
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[a]), base, low[a:z].tobytes(), own[a:z].astype("<u2").tobytes()


_MADE = "bucket long, base long, sigs binary, own binary, doc_id long, t1 long, t2 long, n_shingles long, k1 long, k2 long, sketch binary"
_MADE_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_MADE_NAMES = [c.split()[0] for c in _MADE.split(", ")]


def _sets(size, num, den, buckets):
    """Rows of signatures (bucket >= 0), and one row for each text (bucket < 0, its number as base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bands = once("word-hash", WordHash), Bands(num, den)
        seen: set[tuple[int, int]] = set()
        at = TaskContext.get().partitionId() << 33
        base, held, total = at, [], 0

        def table(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_MADE_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _MADE_TYPES, strict=True)], _MADE_NAMES)

        def packed():
            return table([(*x, *[None] * 7) for x in dealt(held, buckets, base)])

        none = np.zeros(0, np.uint64)
        for b in batches:
            rows = []
            columns = [b.column(i).to_pylist() for i in range(4)]
            for doc_id, t1, t2, s in zip(columns[0], columns[2], columns[3], shingle_sets(columns[1], size, cache), strict=True):
                key = set_key(s)
                if len(s) and key not in seen:
                    held.append(signatures(s, bands))
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                else:
                    held.append(none)
                rows.append((-1 - at % buckets, at, None, None, doc_id, t1, t2, len(s), *key, sketch(s)))
                total += len(held[-1])
                at += 1
                if total >= HELD or len(held) > 65_000:
                    yield packed()
                    base, held, total = at, [], 0
            yield table(rows)
        if held:
            yield packed()

    return run


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        columns = [b.column(k).to_pylist() for k in keys]
        at = 0
        for key, rows in groupby(zip(*columns, strict=True)):
            n = sum(1 for _ in rows)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(at, n))
            at += n
    if held:
        yield last, pa.Table.from_batches(held)


def shared_groups(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, id) for the members of signatures that several ids have; groups with equal members once."""
    order = np.lexsort((ids, sigs))
    sigs, ids = sigs[order], ids[order]
    edges = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
    count = np.diff(np.r_[edges, len(sigs)])
    group = np.add.reduceat(mix(ids.astype(np.uint64) * _N + _M), edges)
    chosen = np.flatnonzero(count > 1)
    chosen = chosen[np.unique(group[chosen], return_index=True)[1]]
    count = count[chosen]
    at = np.arange(count.sum()) + np.repeat(edges[chosen] - (np.cumsum(count) - count), count)
    return np.repeat(group[chosen], count).view(np.int64), ids[at]


_FOUND = "grp long, id long, doc_id long, t1 long, t2 long, n_shingles long, k1 long, k2 long, sketch binary"


def _grouped():
    """Of a bucket of signatures its groups' members (grp, id); rows of texts go through, with id their number."""
    own = ["doc_id", "t1", "t2", "n_shingles", "k1", "k2", "sketch"]
    kinds = dict(zip(_MADE_NAMES, _MADE_TYPES, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:  # sorted, so that texts come first
            split = int(np.searchsorted(b.column("bucket").to_numpy(), 0))
            if split:
                t = b.slice(0, split)
                yield pa.RecordBatch.from_arrays([pa.nulls(split, pa.int64()), t.column("base"), *(t.column(c) for c in own)], ["grp", "id", *own])
            if split < b.num_rows:
                rest.append(b.slice(split))
                break
        for _, t in runs_of(chain(rest, batches), ["bucket"]):
            low = np.frombuffer(b"".join(t.column("sigs").to_pylist()), np.uint8).reshape(-1, 5)
            sigs = np.zeros((len(low), 8), np.uint8)
            sigs[:, :5] = low
            numbers = t.column("own").to_pylist()
            ids = np.repeat(t.column("base").to_numpy(), [len(x) // 2 for x in numbers]) + np.frombuffer(b"".join(numbers), "<u2")
            grp, ids = shared_groups(sigs.view("<u8").ravel(), ids)
            for at in range(0, len(grp), 100_000):
                g, i = grp[at : at + 100_000], ids[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(i), *(pa.nulls(len(g), kinds[c]) for c in own)], ["grp", "id", *own])

    return run


def _between(num, den, forest):
    """Pairs of a group's members that lie in different components and may be similar; of a forest only those that join parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches, ["grp", "i", "j"]):
            key, root, n = (t.column(c).to_numpy() for c in ("key", "root", "n_shingles"))
            order = np.argsort(key)
            key, root, n = key[order], root[order].copy(), n[order]
            raw = [np.frombuffer(x, "<u8") for x in t.column("data").to_pylist()]
            words = min(map(len, raw))
            odd = np.array([folded(raw[i], words) for i in order])
            a, b = [], []
            for x in range(len(key) - 1):
                other = np.flatnonzero((root[x + 1 :] != root[x]) & (np.minimum(n[x + 1 :], n[x]) * den >= num * np.maximum(n[x + 1 :], n[x]))) + x + 1
                if len(other):
                    most = (n[other] + n[x]) * (den - num) // (den + num)
                    other = other[np.bitwise_count(odd[other] ^ odd[x]).sum(axis=1, dtype=np.int64) <= most]
                if len(other) and forest:
                    other = other[np.sort(np.unique(root[other], return_index=True)[1])]
                    root[np.isin(root, root[other])] = root[x]
                if len(other):
                    a.append(np.full(len(other), key[x]))
                    b.append(key[other])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _features(size):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = once("word-hash", WordHash)
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), size, cache)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "data"])

    return run


def may_be_similar(num: int, den: int) -> Callable[[bytes, bytes, int, int], bool]:
    """Whether sketches allow the similarity of two sets of these sizes."""

    def test(x: bytes, y: bytes, m: int, n: int) -> bool:
        a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        words = min(len(a), len(b))
        return np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(dtype=np.int64) <= (m + n) * (den - num) // (den + num)

    return test


def are_similar(num: int, den: int) -> Callable[[bytes, bytes, int, int], bool]:
    """Whether two sets, sorted arrays of features, are similar."""

    def test(x: bytes, y: bytes, m: int, n: int) -> bool:
        both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return den * both >= num * (m + n - both)

    return test


def _tested(test):
    """Rows sorted by (a, part, b): first a's own (b null), then its partners'; the pairs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, own, size = None, b"", 0
        for batch in batches:
            a, b = [], []
            for x, y, n, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_shingles", "data")), strict=True):
                if y is None:
                    owner, own, size = x, data, n
                elif x == owner and test(own, data, size, n):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _passed(pairs: DataFrame, data: DataFrame, test) -> DataFrame:
    """The pairs (a, b) of keys that pass a test of their data(key, n_shingles, data); a's data travel once for BLOCK partners."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("b", F.lit(1)), F.col("parts")).alias("part")
    named = pairs.join(parts, "a").select("a", part, "b")
    partners = named.join(data.withColumnRenamed("key", "b"), "b").select("a", "part", "b", "n_shingles", "data")
    first = parts.join(data.withColumnRenamed("key", "a"), "a")
    owners = first.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "n_shingles", "data")
    rows = owners.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_tested(test), "a long, b long")


class Search:
    """The sets of a table of texts, and which of them are similar."""

    def __init__(self, documents: DataFrame, size: int, num: int, den: int):
        spark = documents.sparkSession
        bound_batches(spark)
        self.folder, self.size, self.num, self.den = Folder(spark), size, num, den
        text = F.col("text").cast("binary")
        self.docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(text, F.lit(2)).alias("t2"))
        total = self.docs.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * DENSITY) // BUCKET)
        made = self.docs.mapInArrow(_sets(size, num, den, buckets), _MADE)
        found = self.folder.write(made.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_grouped(), _FOUND))
        texts = found.filter("grp is null").withColumnRenamed("id", "row").drop("grp")

        # equal sets count once: the key of a set is the number of its first text
        several = texts.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("row").alias("key"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
        several = self.folder.write(several)
        named = texts.join(checked(several), ["k1", "k2"], "left")
        self.texts = self.folder.write(named.withColumn("key", F.coalesce("key", "row")).drop("k1", "k2", "sketch"))
        self.sketches = self.folder.write(named.filter("row = coalesce(key, row)").select(F.col("row").alias("key"), "n_shingles", F.col("sketch").alias("data")))
        keys = self.texts.select(F.col("row").alias("id"), "key", "n_shingles")
        members = found.filter("grp is not null").select("grp", "id").distinct().join(keys, "id")
        self.groups = self.folder.write(members.groupBy("grp", "key").agg(F.first("n_shingles").alias("n_shingles")))
        self.folder.drop(found, several)
        self.roots = self.components()

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of keys, a written table, whose sets are similar."""
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        first = self.texts.join(ends, "key").filter("row = key")
        wanted = self.folder.write(first.select("key", "n_shingles", "t1", "t2", F.col("doc_id").alias("id")))
        # the set is made from one text: where rows repeat, from any of them
        own = checked(wanted.select("key", "t1", "t2", "id"))
        texts = self.docs.join(own, (self.docs["t1"] == own["t1"]) & (self.docs["t2"] == own["t2"]) & self.docs["doc_id"].eqNullSafe(own["id"])).dropDuplicates(["key"])
        sizes = wanted.select("key", "n_shingles")
        sets = self.folder.write(texts.select("key", "text").mapInArrow(_features(self.size), "key long, data binary"))
        # sets go in rounds, each of at most as many pairs as an eighth of the texts
        rounds = max(1, -(-pairs.count() // max(PAIRS, self.texts.count() // 8)))
        found = None
        for k in range(rounds):
            part = pairs.filter(F.pmod(F.xxhash64("a", F.lit(9)), F.lit(rounds)) == k)
            own = self.folder.write(_passed(part, sets.join(sizes, "key").select("key", "n_shingles", "data"), are_similar(self.num, self.den)))
            found = own if found is None else found.union(own)
        self.folder.drop(wanted, sets)
        return found

    def components(self) -> DataFrame:
        """(key, root) of sets that are similar to others."""
        least = self.groups.groupBy("grp").agg(F.min("key").alias("a"), F.max("key").alias("last")).filter("a <> last")
        sizes = self.sketches.select(F.col("key").alias("a"), F.col("n_shingles").alias("size"))
        star = self.groups.join(least, "grp").filter("key <> a").select("a", F.col("key").alias("b"), "n_shingles").distinct().join(sizes, "a")
        fits = F.least("size", "n_shingles") * self.den >= self.num * F.greatest("size", "n_shingles")
        first = self.folder.write(star.filter(fits).select("a", "b"))
        tried = self.folder.write(_passed(first, self.sketches, may_be_similar(self.num, self.den)))
        links = self.confirmed(tried)
        roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        for forest in (True, False):
            late = self.folder.write(self.apart(roots, forest).join(tried, ["a", "b"], "left_anti"))
            if not late.isEmpty():
                links, tried = links.union(self.confirmed(late)), tried.union(late)
                roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        self.folder.drop(first, late, self.groups, self.sketches)
        return roots.withColumnRenamed("node", "key")

    def apart(self, roots: DataFrame, forest: bool) -> DataFrame:
        """Pairs between components that share a group and may be similar."""
        rooted = self.groups.drop("n_shingles").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        blocks = F.ceil(F.col("members") / BLOCK)
        mixed = rooted.groupBy("grp").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("members")).filter("r1 <> r2").select("grp", blocks.alias("blocks"))
        own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks"))
        split = rooted.join(mixed, "grp").select("grp", "key", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        parts = split.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "root").join(self.sketches, "key")
        dealt = parts.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        return dealt.mapInArrow(_between(self.num, self.den, forest), "a long, b long").distinct()

    def rooted(self) -> DataFrame:
        """doc_id, t1, t2 (128 bits of the text), n_shingles, root (equal for all texts that links reach) of each text."""
        return self.texts.join(checked(self.folder.write(self.roots)), "key", "left").select("doc_id", "t1", "t2", "n_shingles", F.coalesce("root", "key").alias("root"))


def join_similar(documents: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their sets of shingles of
    ``size`` words is num / den or more; component_id is the smallest doc_id
    reachable by links.  A text without words, or null, has an empty set and
    links with nothing.  Rows that repeat, and other texts with equal sets,
    are linked; a null doc_id is no smallest one; other columns are ignored;
    an empty table gives no rows.
    """
    search = Search(documents, size, num, den)
    found = search.rooted()
    several = found.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return found.join(checked(search.folder.write(several)), "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of documents without those that repeat or nearly repeat another row: one of each linked group stays.

    It is the one with the smallest doc_id (nulls last; of several such rows
    any one).  This goes by row: rows with one doc_id and different texts are
    different documents.  Texts without words, and nulls, all stay.
    """
    search = Search(documents, size, num, den)
    rows = search.rooted().filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")
    groups = rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = checked(search.folder.write(groups.select("root", "first.doc_id", "first.t1", "first.t2")))
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.t1") == F.col("g.t1")) & (F.col("r.t2") == F.col("g.t2"))
    marked = rows.alias("r").join(groups.alias("g"), "root").select("r.doc_id", "r.t1", "r.t2", same.alias("first"))
    # (doc_id, text) of losers, and of winners that several rows hold
    marked = marked.groupBy("doc_id", "t1", "t2", "first").count().filter("not first or count > 1")
    marked = checked(search.folder.write(marked.select(F.col("doc_id").alias("m_id"), F.col("t1").alias("m_t1"), F.col("t2").alias("m_t2"), "first")))
    # the row travels as one struct, so that none of its names can clash
    whole = documents.select(F.struct("*").alias("d"))
    text = F.col("d.text").cast("binary")
    held = (F.xxhash64(F.lit(1), text) == F.col("m_t1")) & (F.xxhash64(text, F.lit(2)) == F.col("m_t2")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("m_id"))
    kept = whole.join(marked, held, "left_anti").select("d.*")
    again = marked.filter("first")
    if again.isEmpty():
        return kept
    return kept.union(whole.join(again, held).dropDuplicates(["m_id", "m_t1", "m_t2"]).select("d.*"))
