"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every substring of
it.  A text is parsed into phrases, each the longest match found from where
the last one ended; the cross entropy estimate is phrases * log2(N) / n for n
symbols of text and N of training text, and the lowest one wins.

Automata become one dense transition table, so that thousands of text segments
are parsed at a time, one symbol of each by a few array operations.  Parsing
starts anew every SEGMENT bytes, which adds the same to every language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.shared import bound_batches, checked, once, thinned, write_shared

#: Bounds of the labelled sample: documents of a language, and bytes of them in all.
SAMPLE_DOCUMENTS = 400
SAMPLE_BYTES = 48_000
SEGMENT = 1024

NO_LANGUAGE = "und"
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str | None) -> bytes:
    """Lower-cased words of letters and non-ASCII bytes, single spaces between and around; empty without a letter."""
    if not text:
        return b""
    words = text.lower().encode().translate(_LETTERS).split()
    if not words or not (any(w[0] < 128 for w in words) or any(c.isalpha() for c in text)):
        return b""
    return b" " + b" ".join(words) + b" "


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in symbols.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Parser:
    """Automata of all languages in one table.

    An entry is twice the next state's row plus 1 where a phrase ends; a
    phrase that can't go on ends, and the next begins with the same symbol.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        self.width = len(seen) + 1  # symbol 0: never seen in training
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        parts, self.roots, root = [], [], 0
        for x in self.langs:  # one automaton at a time
            moves = automaton(self.symbol[np.frombuffer(samples[x], np.uint8)])
            restart = np.full(self.width, 2 * root * self.width + 1, np.int32)
            for c, to in moves[0].items():
                restart[c] = 2 * (root + to) * self.width + 1
            part = np.tile(restart, (len(moves), 1))
            for state, move in enumerate(moves):
                if move:
                    part[state, list(move)] = [2 * (root + to) * self.width for to in move.values()]
            parts.append(part.ravel())
            self.roots.append(root)
            root += len(moves)
            del moves
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.langs])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases by language and text."""
        parts = [(i, t[a : a + SEGMENT]) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
        total = np.zeros((len(self.langs), len(texts)), np.int64)
        if not parts:
            return total
        parts.sort(key=lambda x: -len(x[1]))
        lengths = np.array([len(p) for _, p in parts])
        grid = np.zeros((len(parts), int(lengths[0])), np.uint8)
        grid[np.arange(lengths[0]) < lengths[:, None]] = self.symbol[np.frombuffer(b"".join(p for _, p in parts), np.uint8)]
        grid = np.ascontiguousarray(grid.T)
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for k, root in enumerate(self.roots):
            state = np.full(len(parts), root * self.width, np.int32)
            count = np.ones(len(parts), np.int32)  # the phrase that is open at the end
            for t, n in enumerate(active.tolist()):
                entry = self.table.take(state[:n] + grid[t, :n])
                count[:n] += entry & 1
                np.right_shift(entry, 1, out=state[:n])
            np.add.at(total[k], [i for i, _ in parts], count)
        return total

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language with the least entropy (ties: the first name), and its distance from the next as a share of it."""
        if not self.langs:
            return [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
        n = np.array([max(1, len(t)) for t in texts])
        entropy = self.phrases(texts) * self.bits[:, None] / n
        best = entropy.argmin(axis=0)
        order = np.sort(entropy, axis=0)
        share = 1 - order[0] / np.maximum(order[min(1, len(order) - 1)], 1e-9) if len(order) > 1 else np.ones(len(texts))
        lang = [self.langs[i] if t else NO_LANGUAGE for i, t in zip(best.tolist(), texts, strict=True)]
        return lang, [float(s) if t else 0.0 for s, t in zip(share.clip(0, 1), texts, strict=True)]


def sample_texts(labelled: DataFrame, max_documents: int = SAMPLE_DOCUMENTS, max_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Normalised training text of each language: whole documents in an order of their hash, within the bounds.

    A document that doesn't fit into what is left is passed over; where none
    fits, the shortest is taken whole.
    """
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", "size")
    rows = labelled.select("lang", "doc_id", F.octet_length("text").alias("size"), "text")
    chosen = thinned(rows.drop("text"), "lang", "doc_id", max_documents).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_documents)
    chosen = checked(write_shared(chosen.groupBy("lang", "doc_id", "size").agg(F.min("nth").alias("nth"))))
    later = F.when(F.col("size") > max_bytes, F.col("size")).otherwise(0)
    texts = rows.join(chosen, ["lang", "doc_id", "size"]).select("lang", "nth", "text", later.alias("later")).orderBy("lang", "later", "nth", "text")
    out: dict[str, bytes] = {}
    for r in texts.toLocalIterator():
        own, text = out.get(r["lang"], b""), normalise(r["text"])
        if not own or len(own) + len(text) <= max_bytes:
            out[r["lang"]] = own + text
    return {k: v for k, v in out.items() if v}


def _predicting(documents: DataFrame, samples: dict[str, bytes]):
    sent = documents.sparkSession.sparkContext.broadcast(samples)

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        key = tuple(sorted((k, hash(v)) for k, v in sent.value.items()))
        parser = once(("cross-parser", key), lambda: Parser(sent.value))
        return parser.predict([normalise(t) for t in texts])

    return predict


def identify(documents: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, lang_pred and score, by least cross-parsing entropy.

    ``und`` with score 0 where the text is null or has no letter, or where
    there is no training text.  Rows that repeat are judged alike; other
    columns are ignored; an empty table gives no rows.
    """
    bound_batches(documents.sparkSession)
    predict = _predicting(documents, samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def only_identified(documents: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """The rows of documents in a learned language, with all their columns; texts without a letter, and nulls, go.

    Where no language was learned there is nothing to judge by, and texts with
    a letter stay.  Rows that repeat stay or go alike; an empty table stays empty.
    """
    bound_batches(documents.sparkSession)
    predict, at, learned = _predicting(documents, samples), documents.columns.index("text"), bool(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            keep = [x != NO_LANGUAGE for x in predict(texts)[0]] if learned else [bool(normalise(t)) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
