"""TF-IDF and vector similarity joins, and leader clustering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators.scratch import Scratch

TFIDF_THRESHOLD, VECTOR_THRESHOLD, LIMIT = 0.28, 0.82, 500
#: Most items whose pairs are all compared, as a threshold of 0 or less asks for.
BOUNDED = 5000
#: Most pivots, and vectors of a cell that one task compares with others.
PIVOTS, CELL = 512, 2048
#: Places for each vector up to which pivots, and matches of rare terms up to which candidates are worth while; beyond, all blocks meet.
FEW = 16
#: Most vectors and numbers in a block, and the vectors a block has at least where all tasks together would fit one.
BLOCK, NUMBERS, LEAST = 1 << 16, 1 << 22, 1000
#: Rows and columns of products, products, and pairs that a task holds at a time; vectors of a block with a term that is added alone.
TILE, PRODUCTS, FOUND, OFTEN = 1024, 1 << 20, 1 << 16, 256
#: What rounding may take off a similarity, and off an angle.
SLACK, ANGLE_SLACK = 1e-8, 1e-6

#: (a, b, sim) with a < b of all pairs of texts(id, text, ...) that are at least as similar as a threshold.
Pairs = Callable[[DataFrame, float], DataFrame]


def tfidf(texts: DataFrame, id: str = "id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(id, term, w): unit vectors of term frequency times ln((N + 1) / (df + 1)) + 1."""
    words = tx.words(F.col(text)) if tokens is None else tokens
    # written, because three steps read it
    tf = Scratch(texts.sparkSession).write(texts.select(F.col(id).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def every_pair(ids: DataFrame, dots: DataFrame, threshold: float) -> DataFrame:
    """All pairs of at most BOUNDED ids, those without a row in dots(a, b, sim) with similarity 0."""
    if ids.limit(BOUNDED + 1).count() > BOUNDED:
        raise ValueError(f"more than {BOUNDED} items: a threshold of 0 or less is for a bounded set")
    x, y = ids.select(F.col("id").alias("a")), ids.select(F.col("id").alias("b"))
    pairs = x.join(F.broadcast(y), F.col("a") < F.col("b")).join(dots, ["a", "b"], "left")
    return pairs.select("a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim")).filter(F.round("sim", 9) >= threshold)


def heads(weights: DataFrame, threshold: float) -> DataFrame:
    """(id, term, s): those terms of unit vectors weights(id, term, w), rare ones first, from which on the norm s reaches the threshold."""
    df = weights.groupBy("term").agg(F.count("*").alias("df"))
    rest = Window.partitionBy("id").orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return weights.join(df, "term").withColumn("s", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).filter(F.col("s") >= threshold - SLACK).select("id", "term", "s")


def candidates(weights: DataFrame, threshold: float, found: DataFrame | None = None) -> DataFrame:
    """(a, b) with a < b: all pairs of unit vectors weights(id, term, w), with the heads ``found``, that may reach the threshold.

    Terms have one order, rare ones first.  Where two vectors' first common
    term is at places from which on their norms are s and t, their product is
    s * t at most; so a vector's terms from which on its norm is below the
    threshold, mostly frequent ones, start no pair, and of the other matches
    only those with s * t at the threshold count.
    """
    found = heads(weights, threshold) if found is None else found
    x, y = found.select(F.col("id").alias("a"), "term", F.col("s").alias("sa")), found.select(F.col("id").alias("b"), "term", F.col("s").alias("sb"))
    return x.join(y, "term").filter((F.col("a") < F.col("b")) & (F.col("sa") * F.col("sb") >= threshold - SLACK)).select("a", "b").distinct()


def blocks(rows: DataFrame, n: int, numbers: int) -> int:
    """Into how many blocks n rows with so many numbers in all are dealt: as few as fit a task, but enough for all cores."""
    fit = max(-(-n // BLOCK), -(-numbers // NUMBERS), 1)
    return max(fit, min(-(-n // LEAST), math.isqrt(4 * rows.sparkSession.sparkContext.defaultParallelism) + 1))


def met(rows: DataFrame, count: int, *key: str) -> DataFrame:
    """(cell, salt, own, ...): rows dealt to ``count`` blocks by their key, and each pair of blocks, cell <= salt, to one task; own ones are of the block cell.

    A row is written once for each block, so that what is shuffled grows with
    the number of blocks, and a task holds one block and reads the other.
    """
    other = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_other")
    spread = rows.select("*", F.pmod(F.xxhash64(*key), F.lit(count)).cast("int").alias("_block"), other)
    low, high = F.least("_block", "_other").alias("cell"), F.greatest("_block", "_other").alias("salt")
    dealt = spread.select(low, high, (F.col("_block") <= F.col("_other")).alias("own"), *rows.columns)
    return dealt.repartition(count * (count + 1) // 2, "cell", "salt").sortWithinPartitions("cell", "salt", F.desc("own"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """((cell, salt), own, rows) of batches in this order."""
    for b in batches:
        keys = np.stack([b.column("cell").to_numpy(), b.column("salt").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start < end:
                yield (int(keys[0, start]), int(keys[1, start])), bool(keys[2, start]), b.slice(start, end - start)


def _pairs(ids: pa.Array, i: np.ndarray, others: pa.Array, j: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), others.take(pa.array(j)), pa.array(sim)], ["a", "b", "sim"])


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").filter("a < b")


class _Postings:
    """Sparse vectors (id, t, w), by term."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.ids, self.n, self.row, self.t, self.w = self.read(parts)
        order = np.argsort(self.t, kind="stable")
        self.doc, self.weight = self.row[order], self.w[order]
        self.terms, self.start, self.count = np.unique(self.t[order], return_index=True, return_counts=True)

    @staticmethod
    def read(parts: list[pa.RecordBatch]) -> tuple[pa.Array, int, np.ndarray, np.ndarray, np.ndarray]:
        ids = pa.concat_arrays([p.column("id") for p in parts])
        sizes = np.concatenate([p.column("t").value_lengths().to_numpy() for p in parts])
        t, w = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in ("t", "w"))
        return ids, len(ids), np.repeat(np.arange(len(ids)), sizes), t, w

    def similar(self, threshold: float, parts: list[pa.RecordBatch] | None = None) -> Iterator[pa.RecordBatch]:
        """Pairs with the vectors of parts, or among one another, each once."""
        ids, n, row, t, w = self.read(parts) if parts else (self.ids, self.n, self.row, self.t, self.w)
        at = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
        known = self.terms[at] == t
        at, row, w = at[known], row[known], w[known]
        step = max(1, PRODUCTS // self.n)
        edges = np.searchsorted(row, np.arange(0, n + step, step))
        for first, a, z in zip(range(0, n, step), edges[:-1], edges[1:], strict=True):
            if a == z:
                continue
            dots = self._dots(at[a:z], row[a:z] - first, w[a:z], min(step, n - first))
            i, j = np.nonzero(dots >= threshold - SLACK)
            sim = dots[i, j]
            good = np.round(sim, 9) >= threshold
            if not parts:
                good &= j < i + first
            i, j, sim = i[good] + first, j[good], sim[good]
            for k in range(0, len(i), FOUND):
                yield _pairs(self.ids, j[k : k + FOUND], ids, i[k : k + FOUND], sim[k : k + FOUND])

    def _dots(self, at: np.ndarray, row: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        """Products of a few vectors, given by their known terms, with all of these."""
        size = self.count[at]
        out = np.zeros(rows * self.n)
        rare = np.flatnonzero(size < OFTEN)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[rare]) // PRODUCTS)) + 1
        for part in np.split(rare, cuts):
            n = size[part]
            place = np.arange(n.sum()) + np.repeat(self.start[at[part]] - np.cumsum(n) + n, n)
            out += np.bincount(np.repeat(row[part] * self.n, n) + self.doc[place], np.repeat(w[part], n) * self.weight[place], len(out))
        out = out.reshape(rows, self.n)
        for e in np.flatnonzero(size >= OFTEN).tolist():
            own = slice(self.start[at[e]], self.start[at[e]] + size[e])
            out[row[e], self.doc[own]] += w[e] * self.weight[own]
        return out


def _multiplied(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over met blocks of sparse vectors: their similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], None
        for key, own, part in _parts(batches):
            if key != group:
                if held and group[0] == group[1]:
                    yield from _Postings(held).similar(threshold)
                group, held, index = key, [], None
            if own:
                held.append(part)
            elif held:
                index = index or _Postings(held)
                yield from index.similar(threshold, [part])
        if held and group[0] == group[1]:
            yield from _Postings(held).similar(threshold)

    return run


def block_pairs(weights: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) as sparse_pairs gives them for a positive threshold, by multiplying blocks of vectors: no pair below it leaves a task."""
    scratch = Scratch(weights.sparkSession)
    # a term of one vector meets nothing
    shared = weights.groupBy("term").agg(F.count("*").alias("df")).filter("df > 1").select("term")
    numbers = scratch.write(shared.select("term", F.monotonically_increasing_id().alias("t")))
    entries = weights.join(numbers, "term").groupBy("id").agg(F.collect_list(F.struct("t", "w")).alias("e"))
    rows = scratch.write(entries.select("id", F.col("e.t").alias("t"), F.col("e.w").alias("w")))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("numbers")).first()
    kind = dict(rows.dtypes)["id"]
    return _in_order(met(rows, blocks(rows, size["n"], size["numbers"]), "id").mapInArrow(_multiplied(threshold), f"a {kind}, b {kind}, sim double"))


def sparse_pairs(weights: DataFrame, threshold: float, ids: DataFrame | None = None) -> DataFrame:
    """(a, b, sim) with a < b: pairs of unit vectors weights(id, term, w) that are at least as similar as the threshold.

    With a positive threshold nothing is compared that shares no rare term,
    where rare terms have few vectors; otherwise blocks of vectors are
    multiplied.  With others all pairs of ids (or of those with a term) are
    compared, and must be few.
    """
    if threshold <= 0:
        x, y = weights.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")), weights.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
        dots = x.join(y, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
        return every_pair(weights.select("id").distinct() if ids is None else ids.select("id"), dots, threshold)
    found = Scratch(weights.sparkSession).write(heads(weights, threshold))
    matches = found.groupBy("term").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    if (matches or 0) > FEW * found.select("id").distinct().count():
        return block_pairs(weights, threshold)
    whole = weights.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v"))
    both = candidates(weights, threshold, found).join(whole.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(whole.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0)))
    return both.select("a", "b", dot.alias("sim")).filter(F.round("sim", 9) >= threshold)


def _units(column: pa.Array) -> np.ndarray:
    sizes = column.value_lengths().to_numpy()
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError("vectors of different lengths")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


class _Pivots:
    """Pivots of vectors(id, v), how far the vectors at home in each one's cell reach, and to how many salts these are dealt."""

    def __init__(self, vectors: DataFrame, threshold: float, n: int, pivots: int | None = None):
        k = pivots or max(1, min(PIVOTS, int(math.sqrt(n) / 2)))
        chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(k).select("v").collect()  # at most PIVOTS
        kind = pa.list_(pa.float64())
        self.sent = vectors.sparkSession.sparkContext.broadcast(_units(pa.array([r["v"] for r in chosen], kind)) if chosen else np.zeros((0, 1)))
        self.near = math.acos(max(-1.0, min(1.0, threshold - SLACK))) + ANGLE_SLACK
        sent = self.sent

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _sliced(batches):
                angles = _angles(_units(b.column("v")), sent.value)
                home = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(angles[np.arange(len(home)), home])], ["cell", "angle"])

        sizes = vectors.select("id", "v").mapInArrow(homes, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n")).collect()  # one row a pivot
        self.reach, self.salts, self.n = np.full(k, -np.inf), np.ones(k, np.int64), np.zeros(k, np.int64)
        for r in sizes:
            self.reach[r["cell"]], self.salts[r["cell"]], self.n[r["cell"]] = r["reach"], max(1, -(-r["n"] // CELL)), r["n"]

    def visits(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Gives, for unit vectors, the home and whether each other cell is visited."""
        sent, near, reach = self.sent, self.near, self.reach

        def of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            angles = _angles(units, sent.value)
            home = angles.argmin(axis=1)
            own = angles[np.arange(len(home)), home]
            return home, (angles <= reach + near) & (angles - own[:, None] <= 2 * near) & (np.arange(len(reach)) < home[:, None])

        return of

    def places(self, vectors: DataFrame) -> int:
        """How many rows the cells of all vectors have, salts included."""
        of, k = self.visits(), len(self.reach)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(k, np.int64)
            for b in _sliced(batches):
                seen += of(_units(b.column("v")))[1].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(seen)], ["cell", "n"])

        seen = vectors.select("id", "v").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # one row a pivot
        return sum(r["n"] * int(self.salts[r["cell"]]) for r in seen) + int((self.n * (self.salts + 1)).sum()) // 2


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, TILE):
            yield b.slice(at, TILE)


def cells(vectors: DataFrame, threshold: float, pivots: int | None = None, chosen: _Pivots | None = None) -> DataFrame:
    """(cell, salt, own, id, v): vectors(id, v) dealt to the cells of pivots, those of CELL vectors and more to several salts.

    A vector's home is the cell of its nearest pivot.  Angles are a metric, so
    one within the threshold's angle t of a vector at home in cell c is at most
    t farther from that cell's pivot than the cell reaches, and at most 2 t
    nearer to its own pivot than to c's; it visits the lower ones of those cells
    and no others.
    """
    chosen = chosen or _Pivots(vectors, threshold, vectors.count(), pivots)
    of, kinds = chosen.visits(), dict(vectors.dtypes)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            home, visits = of(_units(b.column("v")))
            at, cell = np.nonzero(visits)
            at, cell, is_own = np.concatenate([np.arange(len(home)), at]), np.concatenate([home, cell]), np.arange(len(home) + len(at)) < len(home)
            for k in range(0, len(at), TILE):
                to, rows = slice(k, k + TILE), pa.array(at[k : k + TILE])
                yield pa.RecordBatch.from_arrays([pa.array(cell[to], pa.int32()), pa.array(is_own[to]), b.column("id").take(rows), b.column("v").take(rows)], ["cell", "home", "id", "v"])

    placed = vectors.select("id", "v").mapInArrow(dealt, f"cell int, home boolean, id {kinds['id']}, v {kinds['v']}")
    # a vector at home has one salt as its own and is compared in the lower ones; a visitor is compared in all
    count = F.element_at(F.array(*[F.lit(int(s)) for s in chosen.salts]), F.col("cell") + 1)
    mine = F.pmod(F.xxhash64("id"), count).cast("int")
    last = F.when(F.col("home"), mine).otherwise(count - 1).cast("int")
    spread = placed.select("*", mine.alias("_mine"), F.explode(F.sequence(F.lit(0), last)).alias("salt"))
    return spread.select("cell", "salt", (F.col("home") & (F.col("salt") == F.col("_mine"))).alias("own"), "id", "v")


def _close(threshold: float, ids: pa.Array, units: np.ndarray, rough: np.ndarray, others: pa.Array, other: np.ndarray, same: int | None) -> Iterator[pa.RecordBatch]:
    """Similar pairs of own rows and others; ``same`` is the place of the others among the own rows, if they are own rows.

    Products in single precision, tile by tile, exclude what is below the
    threshold by more than their rounding; the others are computed in double.
    """
    least = threshold - SLACK - (units.shape[1] + 8) * 2.0**-22
    other_rough = other.astype(np.float32)
    for x in range(0, len(units), TILE):
        for y in range(0, len(other), TILE):
            i, j = np.nonzero(rough[x : x + TILE] @ other_rough[y : y + TILE].T >= least)
            i, j = i + x, j + y
            if same is not None:
                later = i < j + same
                i, j = i[later], j[later]
            step = max(1, min(FOUND, NUMBERS // units.shape[1]))
            for k in range(0, len(i), step):
                p, q = i[k : k + step], j[k : k + step]
                sim = np.einsum("ij,ij->i", units[p], other[q])
                good = np.round(sim, 9) >= threshold
                if good.any():
                    yield _pairs(ids, p[good], others, q[good], sim[good])


def _compared(threshold: float, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows of cells, or of met blocks if ``whole``, sorted, own ones first: the similar pairs of each cell and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, units, rough = None, None, None, None
        for key, own, part in _parts(batches):
            if key != group:
                group, ids, units, rough = key, None, None, None
            new_ids, new = part.column("id"), _units(part.column("v"))
            if own:
                at = 0 if units is None else len(units)
                ids = new_ids if ids is None else pa.concat_arrays([ids, new_ids])
                units = new if units is None else np.concatenate([units, new])
                rough = units.astype(np.float32)
                if not whole or key[0] == key[1]:
                    yield from _close(threshold, ids, units, rough, new_ids, new, at)
            elif units is not None:
                yield from _close(threshold, ids, units, rough, new_ids, new, None)

    return run


def dense_pairs(vectors: DataFrame, threshold: float, id: str = "id", vec: str = "vec", pivots: int | None = None) -> DataFrame:
    """(a, b, sim) with a < b: all pairs by cosine at the threshold or above; exact, any number of vectors.

    Where pivots exclude too little, all blocks of vectors meet instead.  Null
    vectors and zero vectors are similar to nothing, at a threshold of 0 or
    less to at most BOUNDED others.
    """
    exact = "array<float>" if dict(vectors.dtypes)[vec] == "array<float>" and threshold > 0 else "array<double>"
    given = vectors.select(F.col(id).alias("id"), F.col(vec).cast(exact).alias("v")).filter(F.col("v").isNotNull())
    sound = given.filter(F.exists("v", lambda x: x != 0))
    if threshold <= 0:
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        unit = sound.select("id", F.transform("v", lambda x: x / norm).alias("u"))
        x, y = unit.select(F.col("id").alias("a"), F.col("u").alias("ua")), unit.select(F.col("id").alias("b"), F.col("u").alias("ub"))
        sim = F.aggregate(F.zip_with("ua", "ub", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
        return every_pair(given.select("id"), x.join(F.broadcast(y), F.col("a") < F.col("b")).select("a", "b", sim.alias("sim")), threshold)
    kind = dict(sound.dtypes)["id"]
    size = sound.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    chosen, count = _Pivots(sound, threshold, size["n"], pivots), blocks(sound, size["n"], size["numbers"])
    whole = pivots is None and chosen.places(sound) > max(FEW, count) * size["n"]
    placed = met(sound, count, "id", "v") if whole else cells(sound, threshold, pivots, chosen).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("own"))
    return _in_order(placed.mapInArrow(_compared(threshold, whole), f"a {kind}, b {kind}, sim double"))


def leaders(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, leader): greedy leader clustering of ranked(id, rank) over the similar pairs(a, b, sim).

    In order of rank each item joins the most similar leader so far (ties: the
    latest), or becomes one.  Equivalent and parallel: leaders are the
    lexicographically first maximal independent set of the pairs' graph, found
    in rounds, in which every undecided item without an undecided or leading
    predecessor becomes a leader and its neighbours follow.
    """
    scratch = Scratch(ranked.sparkSession)
    r = scratch.write(ranked.select("id", "rank"))
    a, b = r.select(F.col("id").alias("a"), F.col("rank").alias("ra")), r.select(F.col("id").alias("b"), F.col("rank").alias("rb"))
    sided = pairs.join(a, "a").join(b, "b")
    earlier = F.col("ra") < F.col("rb")
    edges = scratch.write(sided.select(
        F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("lead"),
        F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("item"),
        F.least("ra", "rb").alias("lead_rank"),
        "sim",
    ))
    # items without an earlier neighbour lead at once; what is open waits for its earlier neighbours
    open_edges, roles = edges.select("lead", "item"), None
    waiting = scratch.write(open_edges.select(F.col("item").alias("id")).distinct())
    decided = scratch.write(r.select("id").join(waiting, "id", "left_anti").withColumn("leads", F.lit(True)))
    roles = decided
    while not waiting.isEmpty():
        # followers of new leaders, and then those that wait for nobody any more
        led = scratch.write(open_edges.join(decided.filter("leads").select(F.col("id").alias("lead")), "lead", "left_semi").select(F.col("item").alias("id")).distinct())
        done = decided.select("id").union(led).distinct()
        left = scratch.write(open_edges.join(done.withColumnRenamed("id", "lead"), "lead", "left_anti").join(led.withColumnRenamed("id", "item"), "item", "left_anti"))
        rest = scratch.write(waiting.join(led, "id", "left_anti"))
        still = left.select(F.col("item").alias("id")).distinct()
        new = rest.join(still, "id", "left_anti").select("id", F.lit(True).alias("leads"))
        decided = scratch.write(new.union(led.select("id", F.lit(False).alias("leads"))))
        waiting, open_edges = scratch.write(rest.join(decided.select("id"), "id", "left_anti")), left
        roles = roles.union(decided)
    chosen = roles.filter("leads").select("id")
    best = edges.join(chosen.select(F.col("id").alias("lead")), "lead").groupBy(F.col("item").alias("id")).agg(F.max_by("lead", F.struct(F.round("sim", 9).alias("sim"), "lead_rank")).alias("leader"))
    follow = roles.filter("not leads").select("id").join(best, "id")
    return follow.union(chosen.select("id", F.col("id").alias("leader")))


def ranked_by_length(texts: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """The order of clustering: longest first, ties by id."""
    return texts.withColumn("rank", F.struct((-F.length(text)).alias("n"), F.col(id).alias("id")))


def tfidf_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    return sparse_pairs(Scratch(texts.sparkSession).write(tfidf(texts)), threshold, texts)


def vector_pairs(vec: str) -> Pairs:
    return lambda texts, threshold: dense_pairs(texts, threshold, "id", vec)


def cluster_texts(texts: DataFrame, threshold: float = TFIDF_THRESHOLD, limit: int | None = LIMIT, vec: str | None = None, pairs: Pairs | None = None) -> DataFrame:
    """(id, leader) of texts(id, text), of at most limit where one is given.

    Similarity is that of TF-IDF, of the vectors in column vec, or what
    ``pairs`` finds.
    """
    chosen = texts.orderBy("id").limit(limit) if limit else texts
    found = (pairs or (vector_pairs(vec) if vec else tfidf_pairs))(chosen, threshold)
    return leaders(ranked_by_length(chosen), found)


def summary(texts: DataFrame, clusters: DataFrame, top_terms: int = 6, samples: int = 3) -> DataFrame:
    """One row for each cluster of two or more: size, representative, top_terms by document frequency, members.

    Where texts have a source, also sources, the members of each.
    """
    joined = texts.join(clusters, "id")
    terms = joined.select("leader", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("term")).groupBy("leader", "term").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("df"), "term"))
    best = terms.withColumn("nth", nth).filter(F.col("nth") <= top_terms).groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]).alias("top_terms"))
    sizes = joined.groupBy("leader").agg(F.count("*").alias("size"), F.slice(F.array_sort(F.collect_list("id")), 1, samples).alias("members")).filter("size >= 2")
    lead = texts.select(F.col("id").alias("leader"), F.substring("text", 1, 140).alias("representative"))
    found = sizes.join(lead, "leader").join(best, "leader", "left")
    if "source" in texts.columns:
        own = joined.groupBy("leader", "source").agg(F.count("*").alias("n"))
        found = found.join(own.groupBy("leader").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources")), "leader")
    return found.orderBy(F.desc("size"), "leader")


def singletons(texts: DataFrame, clusters: DataFrame, samples: int = 12) -> DataFrame:
    alone = clusters.groupBy("leader").agg(F.count("*").alias("size")).filter("size = 1").select(F.col("leader").alias("id"))
    return texts.join(alone, "id", "left_semi").orderBy("id").limit(samples).select("id", F.substring("text", 1, 120).alias("sample"))
