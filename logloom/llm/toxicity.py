"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed vectors of the word and of its first
few bytes, so that unseen words with a known stem still mean something.
Filters over one, two and three words are max-pooled over the whole text and
feed a logistic unit.  Everything starts at random and is trained in numpy, by
Adagrad with dropout, for about STEPS steps whatever the size of the sample.

Thresholds are calibrated on labelled rows kept out of training, for each
language; the language is predicted from the text.  A score is shifted so that
0.5 is the threshold of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.language_id import Parser, normalise
from logloom.llm.shared import bound_batches, checked, once, received, send, thinned, write_shared

BUCKETS = 1 << 17
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
STEMS = (3, 4, 5, 6, 7, 8)
BATCH = 48
#: Training steps in all, about; and epochs, at least and at most.
STEPS, EPOCHS = 900, (5, 40)
WORD_CACHE = 100_000

#: Bounds of the labelled sample that training sees: rows of either label, and bytes of text in all.
SAMPLE_ROWS = {1: 3000, 0: 6000}
SAMPLE_BYTES = 40 << 20

_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_WORD).split() if text else []


def buckets_of(word: bytes) -> list[int]:
    own = [word, *(word[:k] + b"^" for k in STEMS if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(x) % BUCKETS for x in own]


def gather(emb: np.ndarray, flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.add.reduceat(emb[flat], edges[:-1], axis=0) if len(flat) else np.zeros((0, emb.shape[1]), np.float32)


@dataclass
class Model:
    emb: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.0
    languages: dict[str, bytes] = field(default_factory=dict)

    def convolve(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled features of texts whose padded word vectors lie at starts in x; an empty text has zeros."""
        pooled, maps = [], []
        for w, b in zip(self.filters, self.bias, strict=True):
            k = len(w)
            n = len(x) - k + 1
            c = x[:n] @ w[0]
            for j in range(1, k):
                c += x[j : n + j] @ w[j]
            c += b
            np.maximum(c, 0, out=c)
            top = np.maximum.reduceat(c, np.minimum(starts, n - 1), axis=0)
            top[sizes == 0] = 0
            pooled.append(top)
            maps.append(c)
        return np.concatenate(pooled, axis=1), maps

    def logits(self, texts: list[list[bytes]], cache: "Vectors") -> np.ndarray:
        out = np.full(len(texts), self.out_bias)
        at = 0
        while at < len(texts):
            total, end = 0, at
            while end < len(texts) and (end == at or total + len(texts[end]) < 200_000):
                total += len(texts[end]) + len(WIDTHS)
                end += 1
            x, starts, sizes = layout([cache.rows(t) for t in texts[at:end]], cache.table)
            pooled, _ = self.convolve(x, starts, sizes)
            out[at:end] = pooled @ self.out + self.out_bias
            at = end
        return out


class Vectors(dict):
    """word -> row of a growing table of word vectors; row 0 is zero."""

    def __init__(self, emb: np.ndarray):
        super().__init__()
        self.emb = emb
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.table, self.used = np.zeros((1 << 12, self.emb.shape[1]), np.float32), 1

    def __missing__(self, word: bytes) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.emb[buckets_of(word)].sum(axis=0)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def layout(rows: list[np.ndarray], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word vectors of all texts in a row, each text followed by zero vectors."""
    pad = np.zeros(len(WIDTHS), np.int32)
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes + len(pad))[:-1]])
    return table[np.concatenate([x for r in rows for x in (r, pad)])], starts, sizes


def fit(texts: list[str], labels: list[int], epochs: int | None = None, seed: int = 5) -> Model:
    if epochs is None:
        epochs = min(EPOCHS[1], max(EPOCHS[0], round(STEPS * BATCH / max(1, len(texts)))))
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    ids: dict[bytes, int] = {}
    flat: list[list[int]] = [[]]
    docs = []
    for t in texts:
        own = []
        for w in words_of(t):
            if (i := ids.get(w)) is None:
                i = ids[w] = len(flat)
                flat.append(buckets_of(w))
            own.append(i)
        docs.append(np.array(own, np.int32))
    counts = np.array([len(x) for x in flat])
    edges = np.cumsum([0, *counts])
    features = np.array([b for x in flat for b in x], np.int64)
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.3 / np.sqrt(k), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    model = Model(emb, filters, bias, out, float(np.log(n1 / n0)) - 1.0)
    dense = [*filters, *bias, out]
    state = [np.full_like(p, 1e-2) for p in dense]
    emb_state = np.full(BUCKETS, 1e-1, np.float32)
    bias_state, rate = 1e-2, 0.05
    weight = np.where(y > 0, np.sqrt(n0 / n1), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            used, inverse = np.unique(np.concatenate([np.zeros(1, np.int32), *(docs[i] for i in chosen)]), return_inverse=True)
            lists = [features[edges[w] : edges[w + 1]] for w in used[1:]]
            lens = np.array([len(x) for x in lists], int)
            table = np.zeros((len(used), DIM), np.float32)
            if len(lists):
                table[1:] = gather(emb, np.concatenate(lists), np.concatenate([[0], np.cumsum(lens)]))
            cut = np.cumsum([1, *(len(docs[i]) for i in chosen)])
            rows = [inverse[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            x, starts, sizes = layout(rows, table)
            where = np.concatenate([z for r in rows for z in (r, np.zeros(len(WIDTHS), np.int32))])
            pooled, maps = model.convolve(x, starts, sizes)
            keep = (rng.random(pooled.shape) > 0.2) / 0.8
            z = (pooled * keep) @ out + model.out_bias
            g = (1 / (1 + np.exp(-z.clip(-30, 30))) - y[chosen]) * weight[chosen] / len(chosen)
            d_out = (pooled * keep).T @ g + 1e-4 * out
            d_pool = np.outer(g, out) * keep * (pooled > 0)
            d_filters, d_bias = [np.zeros_like(f) for f in filters], [np.zeros_like(b) for b in bias]
            d_words = np.zeros_like(table)
            for q, k in enumerate(WIDTHS):
                part = d_pool[:, q * FILTERS : (q + 1) * FILTERS]
                for r in np.flatnonzero(sizes):
                    m = maps[q][starts[r] : starts[r] + sizes[r]]
                    top = m.argmax(axis=0)
                    for j in range(k):
                        pos = starts[r] + top + j
                        d_filters[q][j] += x[pos].T * part[r]
                        np.add.at(d_words, where[pos], part[r][:, None] * filters[q][j].T)
                d_bias[q] = part.sum(axis=0)
            for p, s, d in zip(dense, state, [*d_filters, *d_bias, d_out], strict=True):
                s += d * d
                p -= rate * d / np.sqrt(s)
            bias_state += g.sum() ** 2
            model.out_bias -= float(rate * g.sum() / np.sqrt(bias_state))
            moved = np.flatnonzero(np.abs(d_words[1:]).sum(axis=1))
            if len(moved):
                buckets = np.concatenate([lists[i] for i in moved])
                grads = np.repeat(d_words[1 + moved], lens[moved], axis=0)
                np.add.at(emb_state, buckets, (grads**2).mean(axis=1))
                np.add.at(emb, buckets, (-rate * grads / np.sqrt(emb_state[buckets])[:, None]).astype(np.float32))
    return model


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap that it lies in."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    return float((z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1e-6)


def train(texts: list[str], labels: list[int], held: list[bool], languages: dict[str, bytes], least: int = 15) -> Model:
    """Fits on rows that aren't held; calibrates on those that are, where there are ``least`` of either label, else on all."""
    held_ = np.array(held, bool)
    y = np.array(labels)
    if min((y[held_] == 1).sum(), (y[held_] == 0).sum()) < least:
        held_ = np.zeros(len(y), bool)
    model = fit([t for t, h in zip(texts, held_, strict=True) if not h], y[~held_].tolist())
    model.languages = languages
    check = held_ if held_.any() else np.ones(len(y), bool)
    own = [t for t, h in zip(texts, check, strict=True) if h]
    if not own or not y[check].any():
        return model
    z = model.logits([words_of(t) for t in own], Vectors(model.emb))
    lang = np.array(Parser(languages).predict([normalise(t) for t in own])[0])
    model.default_threshold = threshold(z, y[check])
    for x in set(lang.tolist()):
        m = lang == x
        if min(y[check][m].sum(), (1 - y[check][m]).sum()) >= least:
            model.thresholds[x] = threshold(z[m], y[check][m])
    return model


def sample(documents: DataFrame, labels: DataFrame, calibration: str, rows: dict[int, int] | None = None, max_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int], list[bool]]:
    """Texts, labels and whether a row is kept for calibration, of at most rows[label] documents in hash order.

    A text that doesn't fit into what is left of max_bytes is passed over.
    """
    rows = rows or SAMPLE_ROWS
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(order, "doc_id"))
    bound = F.when(F.col("toxic") == 1, rows[1]).otherwise(rows[0])
    chosen = thinned(marked, "toxic", "doc_id", max(rows.values())).withColumn("nth", nth).filter(F.col("nth") <= bound)
    chosen = checked(write_shared(chosen.select("doc_id", "toxic", F.expr(calibration).alias("held"))))
    found = documents.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id").orderBy(order, "doc_id", "text")
    texts, y, held, left = [], [], [], max_bytes
    for r in found.select("text", "toxic", "held").toLocalIterator():
        size = len(r["text"].encode())
        if size > left:
            continue
        left -= size
        texts.append(r["text"])
        y.append(int(r["toxic"]))
        held.append(bool(r["held"]))
    return texts, y, held


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, score, predicted.

    A null or empty text has the score of no evidence.  The score depends on
    the text alone; repeated rows score alike; other columns are ignored; an
    empty table gives no rows.  A very long text is scored whole: its pooled
    features are the largest of all its windows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    sent = send(spark, model)
    key = xxhash.xxh3_64_hexdigest(model.emb.tobytes() + model.out.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache, parser = once(("toxicity", key), lambda: (x := received(sent), Vectors(x.emb), Parser(x.languages)))
        for b in batches:
            texts = b.column(1).to_pylist()
            if cache.used > WORD_CACHE:
                cache.clear_all()
            z = m.logits([words_of(t) for t in texts], cache)
            lang = parser.predict([normalise(t) for t in texts])[0]
            z -= np.array([m.thresholds.get(x, m.default_threshold) for x in lang])
            score = 1 / (1 + np.exp(-z.clip(-40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
