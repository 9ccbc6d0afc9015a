"""Near-duplicate vectors by NN-descent.

1. Vectors that are equal, with equal labels, count once.
2. A random-projection forest gives each vector first neighbours: vectors of
   one label that lie on the same side of some random hyperplanes share a
   leaf.  There are as many trees as it takes to miss a pair at the threshold
   in all of them with a probability of MISS, at the depth of its label.
3. Rounds of neighbours-of-neighbours joins refine the lists: the vectors that
   a vector lists, or that list it, are compared with each other.  Lists whose
   last entry is still a link are saturated, and become longer.
4. Two audits measure the recall of the lists.  The neighbours of the vectors
   with ids divisible by AUDIT are found by brute force, in blocks.  And PLANTED
   vectors stand among the others, each turned from one of them by an angle
   that just makes a link: their links are known, even where the first audit
   finds few or none; they leave no trace in the result.  Below the aim in
   either audit another forest follows; where forests don't help, all vectors
   are compared with all of their label, so that a result below the aim is
   never returned.
5. Vectors whose lists are saturated at LONGEST entries are compared with all
   of their label, in blocks, and only the links that join parts are written:
   no list is cut, and no group of near copies becomes all of its pairs.

All similarities are cosines of unit vectors in double precision.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.jaccard import runs_of
from logloom.llm.shared import Folder, bound_batches, checked, received, send

#: Entries of a list at first, and at most (beyond, the vector is compared with all).
LIST, LONGEST = 8, 64
#: Vectors that a leaf of a tree is meant to hold, and that are compared in one block.
LEAF, BLOCK = 48, 512
#: Probability that no tree brings a pair at the threshold together.
MISS = 1e-3
#: Bytes of the copies of vectors that are dealt to trees at a time.
TREE_BYTES = 256 << 20
#: Rounds after each forest, forests, and the share of lists below which a round changes too little for another.
ROUNDS, FORESTS, CHANGE = 4, 3, 0.001
#: Ids divisible by this one audit; recall of their links that is enough.
AUDIT, RECALL = 100, 0.99
#: Vectors planted among the others, whose links are known.
PLANTED = 300
#: Bytes of the vectors that are broadcast at a time.
CHUNK_BYTES = 16 << 20
#: Vectors and vectors of the chunk whose similarities are in memory at a time.
ROWS, COLUMNS = 256, 8192
SLACK = 1e-9
_log = logging.getLogger(__name__)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def trees_for(depth: int, threshold: float) -> int:
    """Trees of a depth that miss a pair at the threshold with a probability of MISS."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** depth
    return 1 if together > 1 - 1e-9 else max(2, math.ceil(math.log(MISS) / math.log(1 - together)))


def _leaves(seed: int, first: int, trees: int):
    """Deals vectors to leaves: one row for each tree that its label needs, with the signs of their projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            dims, depth, most = (b.column(c).to_numpy() for c in ("dim", "depth", "trees"))
            for dim in np.unique(dims).tolist():
                for t in range(first, first + trees):
                    rows = np.flatnonzero((dims == dim) & (most > t))
                    if not len(rows):
                        continue
                    if (dim, t) not in planes:
                        planes[dim, t] = np.random.default_rng([seed, dim, t]).normal(size=(dim, 48))
                    own = b.take(pa.array(rows))
                    sides = _unit(own.column("unit"), dim) @ planes[dim, t] > 0
                    code = ((sides & (np.arange(48) < depth[rows][:, None])).astype(np.int64) << np.arange(48)).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([own.column("grp"), pa.array(np.full(len(rows), t, np.int32)), pa.array(code), own.column("id"), own.column("dim"), own.column("unit")], ["grp", "tree", "leaf", "id", "dim", "unit"])

    return run


def _pairs(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)], ["src", "dst", "sim"])


def _in_leaf(keys: list[str]):
    """Each vector's most similar ones of its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, t in runs_of(batches, keys):
            n = t.num_rows
            if n < 2:
                continue
            x, ids, k = _unit(t.column("unit"), t.column("dim")[0].as_py()), t.column("id").to_numpy(), min(LIST, n - 1)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            src = np.repeat(np.arange(n), k)
            parts.append((ids[src], ids[top.ravel()], sims[src, top.ravel()]))
            held += len(src)
            if held > 50_000:
                yield _pairs(parts)
                parts, held = [], 0
        if parts:
            yield _pairs(parts)

    return run


def _local_join():
    """Compares the vectors around one vector; keeps pairs that are nearer than either's last neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, t in runs_of(batches, ["mid"]):
            if t.num_rows < 2:
                continue
            x = _unit(t.column("unit"), t.column("dim")[0].as_py())
            ids, last, fresh = t.column("id").to_numpy(), t.column("last").to_numpy(), t.column("fresh").to_numpy()
            s = x @ x.T
            a, b = np.nonzero((s > last[:, None] + SLACK) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :]))
            if len(a):
                parts.append((ids[a], ids[b], s[a, b]))
                held += len(a)
            if held > 50_000:
                yield _pairs(parts)
                parts, held = [], 0
        if parts:
            yield _pairs(parts)

    return run


def _compared(chunk, threshold: float):
    """Compares vectors with the chunk: (v of the chunk, null, its links here), and (u, v, null) for links that join parts of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = received(chunk)
        known = np.array(sorted(sets), np.int64)
        joined = {g: np.arange(len(own[0])) for g, own in sets.items()}
        counts = {g: np.zeros(len(own[0]), np.int64) for g, own in sets.items()}
        for b in batches:
            grp, ids, copies = (b.column(c).to_numpy() for c in ("grp", "id", "copies"))
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in np.unique(grp[np.isin(grp, known)]).tolist():
                chunk_ids, q = sets[g]
                part, rows = joined[g], np.flatnonzero(grp == g)
                x, own, many = _unit(b.column("unit").take(pa.array(rows)), q.shape[1]), ids[rows], copies[rows]
                for at in range(0, len(rows), ROWS):
                    for to in range(0, len(q), COLUMNS):
                        near = x[at : at + ROWS] @ q[to : to + COLUMNS].T >= threshold
                        near &= own[at : at + ROWS, None] != chunk_ids[None, to : to + COLUMNS]
                        counts[g][to : to + COLUMNS] += many[at : at + ROWS] @ near
                        for r in np.flatnonzero(near.any(axis=1)).tolist():
                            found = to + np.flatnonzero(near[r])
                            parts, first = np.unique(part[found], return_index=True)
                            u.append(np.full(len(parts), own[at + r]))
                            v.append(chunk_ids[found[first]])
                            if len(parts) > 1:
                                part[np.isin(part, parts)] = parts[0]
            u, v = np.concatenate(u), np.concatenate(v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["u", "v", "n"])
        for g, n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(sets[g][0]), pa.nulls(len(n), pa.int64()), pa.array(n)], ["u", "v", "n"])

    return run


class Graph:
    """Neighbour lists (src, dst, sim, fresh, nth) over points(grp, id, copies, dim, unit)."""

    def __init__(self, points: DataFrame, threshold: float, folder: Folder, planted: DataFrame | None = None):
        self.real, self.threshold, self.folder = points, threshold, folder
        points = points if planted is None else points.union(planted)
        self.points = points
        sizes = points.groupBy("grp").agg(F.count("*").alias("n"))
        depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int")
        deepest = sizes.agg(F.max(depth)).first()[0] or 0
        trees = F.create_map(*[F.lit(x) for d in range(deepest + 1) for x in (d, trees_for(d, threshold))])
        sizes = folder.write(sizes.select("grp", depth.alias("depth")).withColumn("trees", trees[F.col("depth")]))
        self.planned, self.trees = points.join(checked(sizes), "grp"), trees_for(deepest, threshold)
        bytes_, rows = points.agg(F.sum("dim") * 8, F.count("*")).first()
        self.rows, self.at_once = rows, max(1, TREE_BYTES // max(1, bytes_ or 0))
        self.longest, self.lists = LIST, None

    def trimmed(self, pairs: DataFrame) -> None:
        """The best neighbours of each vector: LIST of them, up to ``longest`` where all are links."""
        nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
        best = pairs.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh")).withColumn("nth", nth)
        old, self.lists = self.lists, self.folder.write(best.filter((F.col("nth") <= LIST) | ((F.col("sim") >= self.threshold) & (F.col("nth") <= self.longest))))
        if old is not None:
            self.folder.drop(old)

    def known(self, fresh: int) -> DataFrame:
        return self.lists.select("src", "dst", "sim", F.lit(fresh).alias("fresh"))

    def plant(self, seed: int) -> None:
        """Adds the neighbours that a forest gives."""
        keys = ["grp", "tree", "leaf", "block"]
        for first in range(0, self.trees, self.at_once):
            dealt = self.planned.mapInArrow(_leaves(seed, first, self.at_once), "grp long, tree int, leaf long, id long, dim int, unit array<double>")
            # a leaf with very many vectors is cut anew in each tree
            blocks = F.ceil(F.col("count") / BLOCK)
            size = self.folder.write(dealt.groupBy("grp", "tree", "leaf").count().filter(F.col("count") > BLOCK))
            placed = dealt.join(checked(size), ["grp", "tree", "leaf"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id", "tree", F.lit(seed)), blocks), F.lit(0))).drop("count")
            found = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_in_leaf(keys), "src long, dst long, sim double").withColumn("fresh", F.lit(1))
            self.trimmed(found if self.lists is None else found.union(self.lists.select("src", "dst", "sim", "fresh")))
            self.folder.drop(size)

    def refine(self) -> bool:
        """One round of neighbours-of-neighbours joins; whether it changed much."""
        if not self.saturated().isEmpty():
            self.longest = min(LONGEST, self.longest * 2)
        last = self.lists.groupBy("src").agg(F.min("sim").alias("last"), F.count("*").alias("size"))
        room = (F.col("last") >= self.threshold) & (F.col("size") < self.longest)
        last = last.select(F.col("src").alias("id"), F.when(room, F.lit(self.threshold - 2 * SLACK)).otherwise(F.col("last")).alias("last"))
        near = self.lists.filter(F.col("nth") <= LIST)
        near = near.select(F.col("src").alias("mid"), F.col("dst").alias("id"), "fresh").union(near.select(F.col("dst").alias("mid"), F.col("src").alias("id"), "fresh"))
        near = near.groupBy("mid", "id").agg(F.max("fresh").alias("fresh"))
        # those around a vector that very many list are compared in blocks
        size = near.groupBy("mid").agg(F.ceil(F.count("*") / (4 * LONGEST)).alias("cut"), F.max("fresh").alias("any")).filter("any = 1")
        part = F.xxhash64("mid", F.pmod(F.xxhash64("id", F.lit(5)), F.col("cut")))
        around = near.join(size, "mid").select(part.alias("mid"), "id", (F.col("fresh") > 0).alias("fresh"))
        full = around.join(last, "id").join(self.points.select("id", "dim", "unit"), "id").repartition("mid").sortWithinPartitions("mid")
        found = full.mapInArrow(_local_join(), "src long, dst long, sim double").withColumn("fresh", F.lit(1))
        self.trimmed(self.known(0).union(found))
        return (self.lists.agg(F.sum("fresh")).first()[0] or 0) > CHANGE * self.lists.count()

    def links(self) -> DataFrame:
        """(u, v) both ways."""
        own = self.lists.filter(F.col("sim") >= self.threshold).select(F.col("src").alias("u"), F.col("dst").alias("v"))
        return own.union(own.select("v", "u")).distinct()

    def saturated(self) -> DataFrame:
        """Points whose lists are full of links."""
        return self.lists.filter((F.col("nth") == self.longest) & (F.col("sim") >= self.threshold)).select(F.col("src").alias("id"))

    def compare(self, chosen: DataFrame) -> DataFrame:
        """Exact results of chosen points, a block at a time: (u, null, n) with their links, and (u, v, null) that join all of these."""
        chosen = self.folder.write(chosen)
        blocks = max(1, -(-(chosen.agg(F.sum("dim")).first()[0] or 0) * 8 // CHUNK_BYTES))
        met = None
        for k in range(blocks):
            own = chosen.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)) == k).select("grp", "id", "dim", "unit").toArrow()
            grp, sets = own.column("grp").to_numpy(), {}
            for g in np.unique(grp).tolist():
                t = own.take(pa.array(np.flatnonzero(grp == g)))
                sets[g] = t.column("id").to_numpy(), _unit(t.column("unit"), t.column("dim")[0].as_py())
            sent = send(self.points.sparkSession, sets)
            found = self.folder.write(self.real.mapInArrow(_compared(sent, self.threshold), "u long, v long, n long"))
            sent.destroy()
            met = found if met is None else met.union(found)
        self.folder.drop(chosen)
        return self.folder.write(met.filter("v is not null").union(met.filter("v is null").groupBy("u", "v").agg(F.sum("n").alias("n"))))


def planted(points: DataFrame, threshold: float, seed: int, most: int = PLANTED) -> tuple[DataFrame, DataFrame, list[int]]:
    """Vectors like points that link with one of them each, their known links (u, v), and their ids."""
    spark = points.sparkSession
    rng, rows, known = np.random.default_rng([seed, 11]), [], []
    chosen = points.filter("dim > 1").orderBy(F.xxhash64("id", F.lit(seed))).limit(most).collect()  # at most ``most``
    for k, r in enumerate(chosen):
        u = np.array(r["unit"])
        cos = threshold + (1 - threshold) * rng.uniform(0.01, 0.5)
        side = rng.normal(size=len(u))
        side -= (side @ u) * u
        v = cos * u + math.sqrt(max(0.0, 1 - cos * cos)) * side / np.linalg.norm(side)
        own = xxhash.xxh3_64_intdigest(f"{seed}:{k}:{r['id']}") - (1 << 63)
        rows.append((r["grp"], own, 1, r["dim"], (v / np.linalg.norm(v)).tolist()))
        known.append((own, r["id"]))
    return spark.createDataFrame(rows, points.schema), spark.createDataFrame(known, "u long, v long"), [o for o, _ in known]


def link_vectors(vectors: DataFrame, threshold: float = 0.98, seed: int = 3, recall: float = RECALL) -> DataFrame:
    """One row for each row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors with equal labels link when their cosine is at least the
    threshold.  A null label or vector, a zero vector and one with null or
    non-finite components link with nothing; vectors of different lengths
    don't link.  Repeated rows are copies that link with each other; other
    columns are ignored; an empty table gives no rows.  No link below the
    threshold is returned; of those above, ``recall`` at least by each audit,
    whose figures are logged.  A row with a null vec_id links like any other
    and counts for others' n_links; it is no smallest id, and among rows
    without any id component_id and kept are null.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    folder = Folder(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    peak = F.array_max(F.transform("v", lambda x: F.abs(x)))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (peak > 0)
    rows = rows.select("vec_id", "label", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: x / peak + 0.0)).alias("v"))
    key = F.sha2(F.concat_ws("/", "label", F.array_join("v", ",")), 256).alias("same")
    rows = folder.write(rows.select("vec_id", "label", F.when(F.col("v").isNotNull(), key).alias("same"), F.transform("v", lambda x: x / norm).alias("unit")))
    good = rows.filter("same is not null")
    base = folder.write(
        good.groupBy("same")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.max((F.pmod("vec_id", F.lit(AUDIT)) == 0).cast("int")).alias("audit"), F.first("label").alias("label"), F.first("unit").alias("unit"))
        .select(F.xxhash64("same").alias("id"), "same", "first", "copies", "audit", F.xxhash64("label", F.size("unit")).alias("grp"), F.size("unit").alias("dim"), "unit")
    )
    points = base.select("grp", "id", "copies", "dim", "unit")
    extra, known, extra_ids = planted(points, threshold, seed)
    extra = folder.write(extra)
    graph = Graph(points, threshold, folder, extra)
    audit = graph.compare(base.filter("audit = 1").select(*points.columns))
    truth = audit.filter("v is null").select("u", F.col("n").alias("all"))
    copies = base.select(F.col("id").alias("v"), "copies")
    exact, whole = None, False
    for attempt in range(FORESTS + 1):
        if attempt == FORESTS:
            _log.warning("NN-descent stays below the aim; comparing all vectors of a label")
            exact, whole = graph.compare(points), True
            break
        graph.plant(seed + attempt)
        for _ in range(ROUNDS):
            if not graph.refine():
                break
        # a list that is full at its longest is no answer; what it stands for is found exactly below
        counted = graph.links().join(copies, "v").groupBy("u").agg(F.sum("copies").alias("n"))
        full = graph.saturated().select(F.col("id").alias("u"), F.lit(True).alias("full"))
        met = truth.join(counted, "u", "left").join(full, "u", "left").select("all", F.when(F.col("full"), F.col("all")).otherwise(F.coalesce("n", F.lit(0))).alias("n"))
        found, wanted = met.agg(F.sum(F.least("n", "all")), F.sum("all")).first()
        listed = graph.links().join(F.broadcast(known), ["u", "v"], "left_semi").select("u").union(full.join(F.broadcast(known), "u", "left_semi").select("u"))
        shares = [listed.distinct().count() / len(extra_ids)] if extra_ids else []
        shares += [(found or 0) / wanted] if wanted else []
        audited = f"{(found or 0) / wanted:.4f} of {wanted} links" if wanted else "unmeasured (no links)"
        _log.info("after %d forests: recall of planted links %s, of audited vectors %s", attempt + 1, f"{shares[0]:.4f} of {len(extra_ids)}" if extra_ids else "unmeasured", audited)
        if min(shares, default=1.0) >= recall:
            exact = graph.compare(points.join(graph.saturated(), "id", "left_semi").select(*points.columns))
            break
    links = exact.filter("v is not null").union(audit.filter("v is not null")).select("u", "v")
    if not whole:
        # the planted vectors go again
        links = links.union(graph.links().filter(~F.col("u").isin(extra_ids) & ~F.col("v").isin(extra_ids)) if extra_ids else graph.links())
    roots = components(links)
    # exact counts where there are any, else the links found
    counts = exact.union(audit).filter("v is null").groupBy(F.col("u").alias("id")).agg(F.max("n").alias("exact"))
    if not whole:
        lists = graph.links().join(copies, "v").groupBy(F.col("u").alias("id")).agg(F.sum("copies").alias("listed"))
        counts = counts.join(lists, "id", "full")
    else:
        counts = counts.withColumn("listed", F.lit(0))
    counts = counts.select("id", F.coalesce("exact", "listed").alias("n"))
    labelled = base.drop("label", "unit").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    labelled = folder.write(labelled.join(counts, "id", "left"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")).filter("members > 1").select("root", F.col("component_id").alias("least"))
    done = labelled.join(checked(folder.write(least)), "root", "left")
    done = folder.write(done.select("same", F.coalesce("least", "first").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    sound_rows = good.select("vec_id", "same").join(checked(done), "same").select("vec_id", "n_links", "component_id")
    rest = rows.filter("same is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound_rows.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
