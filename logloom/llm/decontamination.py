"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words.  For each pattern length
m a table gives, for every block of two words in a pattern, how far the search
may move on when the text shows that block; an unknown block skips m - 1
words.  Where the shift is zero, the bucket of that block (the pattern's
suffix), narrowed by the pattern's first block, holds the candidates, and a
direct comparison of the words confirms an occurrence.

The tables are broadcast in parts of at most PART_WINDOWS windows, so that
memory stays bounded however many test items there are; a scan applies every
part to every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import bound_batches, received, send

#: Windows in one broadcast table.
PART_WINDOWS = 400_000
#: Bytes of text for which each of many tables is loaded once.
GATHERED = 16 << 20

#: Bytes that are word bytes: ASCII letters and digits, and all of non-ASCII; A-Z become a-z, others a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Table:
    """Shift table and buckets for patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}
        self.count = 0

    def key(self, words: list[bytes], end: int):
        """The block that ends before position end."""
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def add(self, pattern: list[bytes], item: str | None) -> None:
        m = self.length
        for end in range(self.block, m + 1):
            k = self.key(pattern, end)
            self.shift[k] = min(self.shift.get(k, m), m - end)
        bucket = self.buckets.setdefault(self.key(pattern, m), {}).setdefault(self.key(pattern, self.block), {})
        items = bucket.setdefault(tuple(pattern), set())
        self.count += not items
        items.add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str | None]]]:
        """Start of each occurrence, with the items that hold it."""
        m, block, at, n = self.length, self.block, self.length, len(words)
        shift, buckets, free = self.shift, self.buckets, self.length - self.block + 1
        while at <= n:
            k = words[at - 1] if block == 1 else (words[at - 2], words[at - 1])
            move = shift.get(k, free)
            if move:
                at += move
                continue
            start = at - m
            first = words[start] if block == 1 else (words[start], words[start + 1])
            # the narrowed bucket holds whole patterns: the look-up compares the words themselves
            items = buckets[k].get(first, {}).get(tuple(words[start:at]))
            if items:
                yield start, items
            at += 1


def windows(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield words[i : i + size]


def tables(items: Iterator[tuple[str | None, bytes | None]], size: int, part_windows: int = PART_WINDOWS) -> Iterator[list[Table]]:
    """Search tables for parts of the benchmark."""
    part: dict[int, Table] = {}
    held = 0
    for item, text in items:
        for w in windows(words_of(text), size):
            part.setdefault(len(w), Table(len(w))).add(w, item)
            held += 1
        if held >= part_windows:
            yield list(part.values())
            part, held = {}, 0
    if part:
        yield list(part.values())


def occurrences(texts: list[list[bytes]], parts: list) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """For each text the spans of words inside an occurrence, and the items that occur.

    parts are callables; of more than two only the one in use is held in memory.
    """
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[str]] = [set() for _ in texts]
    for part in parts:
        for table in part():
            for words, own, items in zip(texts, spans, found, strict=True):
                for start, of in table.search(words):
                    own.append((start, start + table.length))
                    items |= of
    return spans, found


def gathered(batches: Iterator[pa.RecordBatch], parts: list, most: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The batches; where tables are loaded anew for each, joined to ones of about ``most`` bytes, so that each load serves more text."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if len(parts) <= 2 or sum(x.nbytes for x in held) >= most:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def loading(parts: list) -> list:
    """Callables that give the tables: up to two parts are held, more are loaded anew each time."""
    if len(parts) > 2:
        return [lambda p=p: received(p) for p in parts]
    held = [received(p) for p in parts]
    return [lambda t=t: t for t in held]


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def covered(spans: list[tuple[int, int]]) -> int:
    n, last = 0, 0
    for a, b in sorted(spans):
        n += max(0, b - max(a, last))
        last = max(last, b)
    return n


def _scan(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = loading(parts)
        for b in gathered(batches, parts):
            texts = [words_of(t) for t in b.column(1).to_pylist()]
            spans, found = occurrences(texts, loaded)
            n_words, n_hit = [len(t) for t in texts], [covered(s) for s in spans]
            new = [pa.array(x, pa.int64()) for x in (n_words, n_hit, [len(x - {None}) for x in found])]
            sha = [hashlib.sha256(",".join(sorted(x - {None})).encode()).hexdigest() for x in found]
            flag = pa.array([is_contaminated(w, h) for w, h in zip(n_words, n_hit, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *new, pa.array(sha, pa.string()), flag], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _parts(benchmark: DataFrame, window: int) -> list:
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).filter("text is not null")
    rows = ((r[0], bytes(r[1])) for r in items.toLocalIterator())
    return [send(benchmark.sparkSession, t) for t in tables(rows, window)]


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """One row for each row of documents(doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    benchmark has item_id and text.  A null or wordless text has no words and
    isn't contaminated; a null or wordless item has no windows; items with the
    same id count once.  The windows of items without an id hit words like any
    other, but such items aren't counted or listed.  Repeated documents each give a row; other columns are
    ignored; with an empty benchmark nothing is hit.
    """
    bound_batches(documents.sparkSession)
    parts = _parts(benchmark, window)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(_scan(parts), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def only_clean(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of documents that aren't contaminated, with all their columns."""
    bound_batches(documents.sparkSession)
    parts, at = _parts(benchmark, window), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = loading(parts)
        for b in gathered(batches, parts):
            texts = [words_of(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
            spans, _ = occurrences(texts, loaded)
            keep = [not is_contaminated(len(t), covered(s)) for t, s in zip(texts, spans, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
