"""Plain Lloyd clustering on integer vectors, exact at every step.

The centroids, a few kilobytes, are broadcast with each step's function.  A
step reads the vectors once: every partition finds the nearest centroid of its
rows in NumPy and hands on integer sums for each centroid, which one small
groupBy merges.  All arithmetic is on integers, so neither the number of
partitions nor the order of rows changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import bound_batches, write_shared

#: Components that are read, the scale of their integers, centroids and rounds.
DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Largest integer component: squared differences of two such vectors then fit a long, as do sums of 2^36 of them.
LARGEST = 1 << 27
#: Rows whose differences are held at a time.
BLOCK = 8192


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): rows with exactly ``dimensions`` components, none null or not finite, as integers floor(scale * x)."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    small = F.forall("x", lambda e: F.abs(e * scale) < float(LARGEST))
    kept = x.filter((F.size("x") == dimensions) & finite)
    v = F.when(small, F.transform("x", lambda e: F.floor(e * scale))).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST // scale} has no squared distance that a long can hold")))
    return kept.select("vec_id", v.cast("array<long>").alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The vectors of the k smallest sha256 of ``<seed>:<vec_id>``; ties by components; rows without vec_id are never chosen."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.filter("vec_id is not null").orderBy(rank, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the lowest of equals, and the squared distance to it."""
    cluster, distance = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for a in range(0, len(v), BLOCK):
        block = v[a : a + BLOCK]
        squares = np.empty((len(block), len(centroids)), np.int64)
        for c, center in enumerate(centroids):
            d = block - center
            squares[:, c] = np.einsum("ij,ij->i", d, d)
        cluster[a : a + BLOCK] = own = squares.argmin(axis=1)
        distance[a : a + BLOCK] = squares[np.arange(len(block)), own]
    return cluster, distance


def partial_sums(centroids: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: rows and component sums of each centroid's vectors in a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if len(batch):
                v = np.vstack(batch["v"].to_list())
                cluster, _ = nearest(v, centroids)
                rows += np.bincount(cluster, minlength=len(centroids))
                for c in np.unique(cluster):
                    sums[c] += v[cluster == c].sum(axis=0)
        held = np.flatnonzero(rows)
        yield pd.DataFrame({"cluster": held, "n": rows[held], "sums": [s.tolist() for s in sums[held]]})

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor(sum / count) of their vectors; those without any stay."""
    partial = vectors.select("v").mapInPandas(partial_sums(centroids), "cluster int, n long, sums array<long>")
    merged = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(centroids.shape[1])]).alias("sums"))
    out = centroids.copy()
    for r in merged.collect():  # as many rows as centroids
        out[r["cluster"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(np.vstack(batch["v"].to_list()), centroids)
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})

    return vectors.mapInPandas(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """One row for each kept row of embeddings(vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, null vectors and those with a null, NaN or
    infinite component are left out.  Rows that repeat each count and give a
    row.  A row without vec_id counts and is assigned, but starts no centroid.
    With fewer vectors than k there are as many centroids as vectors with an
    id; without any, as with an empty table, there are no rows.  Components of
    LARGEST / scale and more are an error, because no long holds their squared
    distances.  Other columns are ignored, whatever their names.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    vectors = integer_vectors(embeddings, dimensions, scale)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], names)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = write_shared(assigned(vectors, centroids))
    of = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # as many rows as centroids
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in of}
    by = {c: F.create_map(*[F.lit(x) for c_ in sorted(of) for x in (c_, values[c_])]) for c, values in (("d", of), ("s", digest))}
    return found.select(
        "vec_id", "cluster", "distance", F.element_at(by["d"], F.col("cluster")).cast("long").alias("cluster_inertia"),
        F.lit(sum(of.values())).cast("long").alias("inertia"), F.element_at(by["s"], F.col("cluster")).alias("centroid_sha256"),
    )


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """The same over DuckDB's view embeddings: one assignment and one mean for each round."""

    def near(n: int) -> str:
        squares = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
        return f"a{n} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := {squares}::BIGINT, k := k)) AS best FROM q, c{n} GROUP BY r)"

    def mean(n: int) -> str:
        floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
        sums = f"SELECT best.k AS k, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n}, range(1, {dimensions + 1}) AS t(i) GROUP BY ALL"
        return f"m{n} AS (SELECT k, list({floor} ORDER BY i) AS c FROM ({sums}) GROUP BY k), c{n + 1} AS (SELECT k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))"

    steps = ", ".join(f"{near(n)}, {mean(n)}" for n in range(rounds))
    whole = f"len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}"
    return f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {whole}),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, v FROM q WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})),
{steps}, {near(rounds)},
own AS (SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM own JOIN c{rounds} ON k = cluster"""
