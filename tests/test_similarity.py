"""Similarity joins, clustering and embedding against all pairs and plain loops."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.operators import embedding, similarity

WORDS = [f"word{i:03d}" for i in range(300)]


def texts(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        own = [WORDS[min(int(r.expovariate(0.02)), 299)] for _ in range(r.randint(1, 12))]
        rows.append((i, " ".join(own if i % 3 or not rows else [*rows[-1][1].split()[: r.randint(1, 9)], *own[:2]])))
    return [*rows, (n, ""), (n + 1, "12 34"), (n + 2, "word001"), (n + 3, "word001")]


def plain_pairs(weights, ids, threshold):
    out = {}
    for a in ids:
        for b in ids:
            if a < b:
                sim = sum(w * weights.get(b, {}).get(t, 0.0) for t, w in weights.get(a, {}).items())
                if round(sim, 9) >= threshold:
                    out[a, b] = sim
    return out


@pytest.mark.parametrize("threshold", [0.28, 0.6, 1.0, 0.0, -1.0])
def test_sparse_pairs(spark, threshold):
    given = spark.createDataFrame(texts(150), "id long, text string").repartition(5)
    weights = similarity.tfidf(given).persist()
    table = {}
    for r in weights.collect():
        table.setdefault(r["id"], {})[r["term"]] = r["w"]
    found = similarity.sparse_pairs(weights, threshold, given).collect()
    expected = plain_pairs(table, [i for i, _ in texts(150)], threshold)
    assert len(found) == len(expected) and {(r["a"], r["b"]): r["sim"] for r in found} == pytest.approx(expected, abs=1e-8)
    if threshold >= 0.28:
        met = similarity.candidates(weights, threshold)
        tried = met.count()
        sharing = len(plain_pairs(table, list(table), 1e-9))
        assert len(expected) <= tried < sharing * (0.8 if threshold < 0.5 else 0.5)  # pairs of frequent words alone are never compared


def shuffled(spark, action):
    """What action returns, and the number of rows that its stages shuffled."""
    sc = spark.sparkContext._jsc.sc()
    jvm = spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = action()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_common_terms_shuffle_no_pairs(spark, monkeypatch):
    """where most texts share a few terms, what is shuffled grows with the texts and not with their pairs."""
    monkeypatch.setattr(similarity, "PRODUCTS", 5000)
    monkeypatch.setattr(similarity, "OFTEN", 20)
    monkeypatch.setattr(similarity, "LEAST", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    r, rows = random.Random(4), {}
    for n in (200, 400):
        given = [(i, " ".join(r.sample(WORDS, 12))) for i in range(n)]
        weights = similarity.tfidf(spark.createDataFrame(given, "id long, text string").repartition(5)).persist()
        table = {}
        for row in weights.collect():
            table.setdefault(row["id"], {})[row["term"]] = row["w"]
        found, rows[n] = shuffled(spark, lambda w=weights: similarity.sparse_pairs(w, 0.2).collect())
        expected = plain_pairs(table, list(table), 0.2)
        assert len(found) == len(expected) and {(r["a"], r["b"]): r["sim"] for r in found} == pytest.approx(expected, abs=1e-8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows[400] < 2.5 * rows[200]


def test_a_threshold_of_zero_needs_few_items(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BOUNDED", 3)
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id int, vec array<double>")
    assert similarity.dense_pairs(v, 0.9).count() == 2
    with pytest.raises(ValueError):
        similarity.dense_pairs(v, 0.0)


def vectors(n, dim, seed=2):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(20, dim))
    rows = [(int(i), (centers[i % 20] + r.normal(scale=0.25, size=dim)).tolist()) for i in range(n)]
    return [*rows, (n, rows[0][1]), (n + 1, [2 * x for x in rows[1][1]]), (n + 2, [0.0] * dim), (n + 3, None), (n + 4, [-x for x in rows[0][1]])]


@pytest.mark.parametrize(("threshold", "pivots", "cell"), [(0.82, None, 2048), (0.95, 40, 7), (0.3, 3, 16), (1.0, 16, 50), (0.5, 1, 9)])
def test_dense_pairs(spark, monkeypatch, threshold, pivots, cell):
    monkeypatch.setattr(similarity, "CELL", cell)
    rows = vectors(400, 12)
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(6)
    found = similarity.dense_pairs(df, threshold, pivots=pivots).collect()
    sound = [(i, np.array(v)) for i, v in rows if v is not None and any(v)]
    ids, unit = [i for i, _ in sound], np.stack([v / np.linalg.norm(v) for _, v in sound])
    sim = np.round(unit @ unit.T, 9)
    expected = {(ids[x], ids[y]): float(sim[x, y]) for x, y in zip(*np.nonzero(np.triu(sim >= threshold, 1)), strict=True)}
    assert len(found) == len(expected) and {(r["a"], r["b"]): r["sim"] for r in found} == pytest.approx(expected, abs=1e-8)


def test_pivots_that_exclude_little(spark, monkeypatch):
    """at a low threshold in many dimensions a vector goes to each block once, not to the cells of most pivots; equal vectors leave in small batches."""
    monkeypatch.setattr(similarity, "BLOCK", 1500)
    monkeypatch.setattr(similarity, "FOUND", 1000)
    unit = np.random.default_rng(5).normal(size=(6000, 24)).astype(np.float32)
    unit[:300] = unit[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, vec array<float>").repartition(4).persist()
    df.count()
    found, rows = shuffled(spark, lambda: similarity.dense_pairs(df, 0.6).collect())
    assert rows < 6000 * 8
    unit = unit.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9)
    expected = {(x, y): float(sim[x, y]) for x, y in zip(*(i.tolist() for i in np.nonzero(np.triu(sim >= 0.6, 1))), strict=True)}
    assert len(found) == len(expected) and {(r["a"], r["b"]): r["sim"] for r in found} == pytest.approx(expected, abs=1e-8)
    ids = pa.array(range(300), pa.int64())
    batches = list(similarity._close(0.6, ids, unit[:300], unit[:300].astype(np.float32), ids, unit[:300], 0))
    assert sum(b.num_rows for b in batches) == 300 * 299 // 2 and max(b.num_rows for b in batches) <= 1000


def test_pivots_prune(spark):
    df = spark.createDataFrame(vectors(600, 12)[:600], "id long, v array<double>")
    placed = similarity.cells(df, 0.95, 20).groupBy("cell").agg(F.count_if("own").alias("own"), F.count("*").alias("n")).collect()
    compared = sum(r["own"] * (r["own"] - 1) // 2 + r["own"] * (r["n"] - r["own"]) for r in placed)
    assert sum(r["own"] for r in placed) == 600 and compared < 0.35 * 600 * 599 / 2


def test_an_own_similarity(spark):
    """Any function that gives pairs can take the place of cosine."""

    def by_length(given, threshold):
        x, y = given.select(F.col("id").alias("a"), F.length("text").alias("na")), given.select(F.col("id").alias("b"), F.length("text").alias("nb"))
        sim = 1 - F.abs(F.col("na") - F.col("nb")) / F.greatest("na", "nb")
        return x.join(y, F.col("a") < F.col("b")).select("a", "b", sim.alias("sim")).filter(F.col("sim") >= threshold)

    given = spark.createDataFrame([(1, "x" * 10), (2, "y" * 11), (3, "z" * 30), (4, "w" * 29), (5, "v")], "id int, text string")
    found = {r["id"]: r["leader"] for r in similarity.cluster_texts(given, 0.9, pairs=by_length).collect()}
    assert found == {1: 2, 2: 2, 3: 3, 4: 3, 5: 5}


def greedy(rows, table, threshold):
    order = sorted(rows, key=lambda r: (-len(r[1]), r[0]))
    lead, out = [], {}
    for i, _ in order:
        sims = [(round(sum(w * table.get(j, {}).get(t, 0.0) for t, w in table.get(i, {}).items()), 9), n) for n, j in enumerate(lead)]
        best = max(((s, n) for s, n in sims if s >= threshold), default=None)
        out[i] = lead[best[1]] if best else i
        if not best:
            lead.append(i)
    return out


@pytest.mark.parametrize("threshold", [0.28, 0.0])
def test_clusters_of_texts(spark, threshold):
    given = spark.createDataFrame(texts(90, 7), "id long, text string").repartition(3)
    table = {}
    for r in similarity.tfidf(given).collect():
        table.setdefault(r["id"], {})[r["term"]] = r["w"]
    found = {r["id"]: r["leader"] for r in similarity.cluster_texts(given, threshold, limit=None).collect()}
    assert found == greedy(texts(90, 7), table, threshold)


def test_embedding_runs_in_the_workers(spark, tmp_path):
    seen = str(tmp_path)
    driver = os.getpid()

    def load():
        made = os.getpid()

        def encode(given):
            assert len(given) <= 7
            if os.getpid() != driver:
                with open(f"{seen}/{os.getpid()}", "a", encoding="utf-8") as f:
                    f.write(f"{made} {len(given)}\n")
            return [[float(len(t)), 1.0] for t in given]

        return encode

    given = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(40)], "id int, text string").repartition(2)
    found = embedding.embedded(given, load, "lengths", batch=7).collect()
    assert {r["id"]: r["vec"] for r in found} == {i: None if i == 3 else [float(i), 1.0] for i in range(40)}
    calls = [line.split() for name in os.listdir(seen) for line in open(f"{seen}/{name}", encoding="utf-8")]
    assert sum(int(n) for _, n in calls) == 39 and len(calls) >= 6
    assert all({line.split()[0] for line in open(f"{seen}/{name}", encoding="utf-8")} == {name} for name in os.listdir(seen))  # loaded once, where it runs
    assert embedding.embedded(given, lambda: None, "none") is None
    assert math.isclose(sum(found[0]["vec"] or [1.0]), sum(found[0]["vec"] or [1.0]))
