"""Token counts: pieces are counted once per distinct pre-token.

1. A first scan counts pre-tokens; each distinct one is encoded once and the
   vocabulary (pre-token, frequency, pieces) is written to the shared folder.
2. A second scan takes each document's pre-token frequencies and joins them to
   the vocabulary.  The most frequent pre-tokens, at most HEAD_ENTRIES by
   construction, are joined by a broadcast; all others by a shuffle join, in
   which no key can be hot, because every hot one is in the head.
3. Products of frequency and pieces are summed for each document.  No ids of a
   document are ever made.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.bpe import Bpe, Cache, Irregular, chunks, load, plain_tokens, whole_chunk
from logloom.llm.shared import bound_batches, once, write_shared

#: Bound on pre-tokens that are broadcast.
HEAD_ENTRIES = 1 << 17

#: Distinct chunks that one task holds before it hands them on, and their characters.
TASK_ENTRIES, TASK_CHARS = 300_000, 16 << 20


class PreTokens(Cache):
    """chunk -> its pre-tokens."""

    def make(self, key: str) -> tuple[str, ...]:
        return tuple(self.bpe.pre_tokens(whole_chunk(key)))


class HeadTail(Cache):
    """chunk -> pieces of its pre-tokens in the head, and its other pre-tokens."""

    def __init__(self, bpe: Bpe, pieces: dict[str, int]):
        super().__init__(bpe)
        self.pieces = pieces

    def split(self, pre_tokens: list[str]) -> tuple[int, tuple[str, ...]]:
        get = self.pieces.get
        return sum(get(p, 0) for p in pre_tokens), tuple(p for p in pre_tokens if p not in self.pieces)

    def make(self, key: str) -> tuple[int, tuple[str, ...]]:
        return self.split(self.bpe.pre_tokens(whole_chunk(key)))

    def count(self, text: str) -> tuple[int, Counter]:
        """Pieces of a text's pre-tokens in the head, and the frequencies of the others."""
        first, rest = chunks(text)
        tail: Counter = Counter()
        try:
            if first and first.split() != [first]:
                raise Irregular
            total, others = self.split(self.bpe.pre_tokens(first))
            tail.update(others)
            get = self.pieces.get
            for key, n in Counter(rest).items():
                plain = plain_tokens(key)
                if plain is not None:  # words need no cache
                    for p in plain:
                        known = get(p)
                        if known is None:
                            tail[p] += n
                        else:
                            total += known * n
                    continue
                known, others = self[key]
                total += known * n
                for p in others:
                    tail[p] += n
            return total, tail
        except Irregular:
            total, others = self.split(self.bpe.pre_tokens(text))
            return total, Counter(others)


def _vocabulary(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = load(spec, PreTokens)
        seen: dict[str, int] = {}  # of chunks
        alone: Counter = Counter()  # of pre-tokens
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            """What was seen, in parts; a pre-token of several chunks comes several times."""
            token, count = [], []
            for key, n in chain(((plain_tokens(k) or pre[k], n) for k, n in seen.items()), (((p,), n) for p, n in alone.items())):
                token += key
                count += [n] * len(key)
                if len(token) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(count, pa.int64())], ["pre_token", "n"])
                    token, count = [], []
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(count, pa.int64())], ["pre_token", "n"])
            seen.clear()
            alone.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                first, rest = chunks(text)
                try:
                    if first and first.split() != [first]:
                        raise Irregular
                    distinct = Counter(rest)
                    fresh = [key for key in distinct if key not in seen]
                    for key in fresh:
                        if not key.isalpha():
                            whole_chunk(key)
                    for key, n in distinct.items():
                        seen[key] = seen.get(key, 0) + n
                    held += sum(map(len, fresh))
                    head = first
                except Irregular:
                    head = text
                own = pre.bpe.pre_tokens(head)
                held += sum(map(len, own))
                alone.update(own)
                if len(seen) + len(alone) >= TASK_ENTRIES or held >= TASK_CHARS:
                    yield from rows()
                    held = 0
        yield from rows()
        pre.empty()

    return run


def _pieces(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = load(spec, PreTokens).bpe.ids
        for b in batches:
            n = [len(ids(p)) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], ["pre_token", "freq", "pieces"])

    return run


def _documents(spec, head, name):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = once(("head", name), lambda: HeadTail(load(spec, PreTokens).bpe, head.value))
        row = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        names = ["row", "doc_id", "n_bytes", "n_tokens", "pre_token", "n"]
        for b in batches:
            rows, ids, size, known, tail, freq = [], [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row += 1
                total, others = table.count(text or "")
                rows.append(row)
                ids.append(doc_id)
                size.append(len(text.encode()) if text else 0)
                known.append(total)
                tail.append(f"\0{row}")
                freq.append(0)
                n = len(others)
                rows += [row] * n
                ids += [None] * n
                size += [None] * n
                known += [0] * n
                tail += others.keys()
                freq += others.values()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((rows, ids, size, known, tail, freq), kinds, strict=True)], names)

    return run


def head_table(vocabulary: DataFrame, limit: int = HEAD_ENTRIES) -> dict[str, int]:
    """The pre-tokens from the least frequency on at which no more than limit qualify."""
    level = F.floor(F.log(F.col("freq").cast("double")) * 16)
    floor, total = None, 0
    for r in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > limit:
            break
        floor = r["level"]
    if floor is None:
        return {}
    rows = vocabulary.filter(level >= floor).select("pre_token", "pieces").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def count_tokens(documents: DataFrame, vocabulary_path: str, limit: int = 1024, head_entries: int = HEAD_ENTRIES) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens).  Repeated rows and
    repeated doc_ids each give their own row; other columns are ignored; an
    empty table gives an empty result.  Texts of any length are counted whole.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = write_shared(
        docs.select("text")
        .mapInArrow(_vocabulary(spec), "pre_token string, n long")
        .groupBy("pre_token")
        .agg(F.sum("n").alias("freq"))
        .mapInArrow(_pieces(spec), "pre_token string, freq long, pieces int")
    )
    head = spark.sparkContext.broadcast(head_table(vocabulary, head_entries))
    found = docs.mapInArrow(_documents(spec, head, uuid.uuid4().hex), "row long, doc_id long, n_bytes long, n_tokens long, pre_token string, n long")
    n_tokens = F.sum(F.col("n_tokens") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("n_tokens")
    return (
        found.join(vocabulary.select("pre_token", "pieces"), "pre_token", "left")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), n_tokens)
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
