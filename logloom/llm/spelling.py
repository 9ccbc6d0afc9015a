"""Spelling variants: words one edit apart, grouped under the far more frequent form.

Of two words one edit apart, the shorter of m characters, either the first or
the last m // 2 characters agree.  So words are dealt to buckets by m and that
half.  A task holds the buckets that fall to it in one minimal automaton, of
the words or of the reversed ones, follows a word's half exactly and completes
it with one error; the automaton's word numbers name what was found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.automata import Automaton, common_prefix
from logloom.llm.shared import Folder, bound_batches, checked

#: Shortest words, in characters, and their fewest occurrences; how much more frequent a form is.
SHORTEST, FEWEST, RATIO = 7, 2, 10
#: One run in so many, by its checksum, loses a character.
MUTED = 31
#: Words of one automaton: buckets with more are dealt to several, and so many make a task on average.
WORDS_PER_AUTOMATON = 1 << 15
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000


def _runs(shortest: int) -> re.Pattern[str]:
    return re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")


def muted(doc: str, run: str, every: int = MUTED) -> str:
    """The run, without one character where its checksum says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, shortest: int = SHORTEST, every: int = MUTED) -> DataFrame:
    """(word, n) over whole texts, counted in the tasks first.

    Runs of letters are lower-cased in A-Z only.  Each distinct run of a text
    is muted once, because the checksum is the same wherever it stands in it.
    """
    bound_batches(documents.sparkSession)
    given = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, held = _runs(shortest), Counter()
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                lowered = text.encode().lower().decode()  # bytes know A-Z only
                for run, n in Counter(m.group() for m in runs.finditer(lowered)).items():
                    word = muted(doc, run, every)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pd.DataFrame(held.items(), columns=["word", "n"])
                    held = Counter()
        yield pd.DataFrame(held.items(), columns=["word", "n"]).astype({"n": "int64"})

    partial = given.mapInPandas(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _entries(words: DataFrame, backward: bool, most: int, shortest: int) -> tuple[DataFrame, int]:
    """(m, half, salt, own, word, n), dealt to tasks by bucket and salt, own rows first; and the number of tasks.

    A word of L characters is in the buckets of m = L and m = L - 1.  A bucket
    of more than ``most`` words is dealt to several automata: each word has its
    own one and is looked up in the others, too.
    """
    read = F.reverse("word") if backward else F.col("word")
    both = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")).filter(F.col("m") >= shortest)
    keyed = both.withColumn("half", F.xxhash64(F.substring(read, F.lit(1), (F.col("m") / 2).cast("int"))))
    sizes = keyed.groupBy("m", "half").agg(F.count("*").alias("size"))
    large = Folder(words.sparkSession).write(sizes.filter(F.col("size") > most).select("m", "half", F.ceil(F.col("size") / most).cast("int").alias("salts")))
    salted = keyed.join(checked(large), ["m", "half"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = salted.withColumn("home", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # characters, not words, are what an automaton's memory grows with
    volume = keyed.agg(F.sum(F.greatest(F.lit(1), F.length("word") / 16))).first()[0] or 0
    tasks = max(1, -(-int(volume) // most))
    rows = dealt.select("m", "half", "salt", (F.col("salt") == F.col("home")).alias("own"), "word", "n")
    return rows.repartition(tasks, "m", "half", "salt").sortWithinPartitions(F.desc("own")), tasks


def _looked_up(backward: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over the rows of _entries: each word's number of near words and the best of them."""

    def spelled(m: int, salt: int, word: str) -> str:
        return chr(m % 0xD000) + chr(salt % 0xD000) + chr(salt // 0xD000) + (word[::-1] if backward else word)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[tuple[str, str, int]] = []
        automaton: Automaton | None = None

        def near(m: int, salt: int, word: str) -> list[tuple[int, str]]:
            text, half = spelled(m, salt, word), m // 2
            start = automaton.follow(automaton.root, 0, text[: 3 + half])
            if start is None:
                return []
            rest = text[3 + half :]
            # of two words of m and m + 1 characters the longer one loses one; two of m + 1 meet in the next bucket
            numbers = set(automaton.deleted(*start, rest) if len(word) > m else automaton.replaced_or_inserted(*start, rest))
            found = [own[k][1:] for k in numbers]
            # what agrees in the first half is found by the forward automaton
            return [(n, w) for w, n in found if not (backward and common_prefix(w, word) >= half)]

        def answers(rows: list[tuple[int, int, str]]) -> pd.DataFrame:
            out = []
            for m, salt, word in rows:
                found = near(m, salt, word)
                if found:
                    n, best = min((-n, w) for n, w in found)
                    out.append((word, len(found), best, -n))
            return pd.DataFrame(out, columns=["word", "n_near", "near", "near_n"]).astype({"n_near": "int64", "near_n": "int64"})

        asked: list[tuple[int, int, str]] = []

        def built() -> Automaton:
            own.sort()
            return Automaton(text for text, _, _ in own)

        for batch in batches:
            mine = batch[batch["own"]]
            if len(mine):  # all rows of own words come first
                own += [(spelled(m, s, w), w, n) for m, s, w, n in zip(mine["m"], mine["salt"], mine["word"], mine["n"], strict=True)]
                asked += list(zip(mine["m"], mine["salt"], mine["word"], strict=True))
            others = batch[~batch["own"]]
            if len(others):
                automaton = automaton or built()
                yield answers(list(zip(others["m"], others["salt"], others["word"], strict=True)))
        automaton = automaton or built()
        for a in range(0, len(asked), 1 << 13):
            yield answers(asked[a : a + (1 << 13)])

    return run


def near_words(words: DataFrame, most: int = WORDS_PER_AUTOMATON, shortest: int = SHORTEST) -> DataFrame:
    """(word, n_near, near, near_n) for words(word, n) with a near word: how many, and the most frequent, ties the smallest."""
    bound_batches(words.sparkSession)
    found = None
    for backward in (False, True):
        rows, _ = _entries(words, backward, most, shortest)
        part = rows.mapInPandas(_looked_up(backward), "word string, n_near long, near string, near_n long")
        found = part if found is None else found.union(part)
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.w").alias("near"), (-F.col("best.k")).alias("near_n"))


def variants(documents: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, ratio: int = RATIO, most: int = WORDS_PER_AUTOMATON, every: int = MUTED) -> DataFrame:
    """One row for each word of documents(doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of letters of ``shortest`` characters that occur ``fewest``
    times.  A word's form is its most frequent word one edit away, ties the
    smallest, if that is ``ratio`` times as frequent; root follows forms to the
    last.  A null doc_id counts as empty text in the checksum; null and empty
    texts have no words; rows that repeat each count; texts of any length are
    read whole, and a word of any length is one string of its task; an empty
    table gives no rows; other columns are ignored.
    """
    folder = Folder(documents.sparkSession)
    words = folder.write(word_counts(documents, shortest, every).filter(F.col("n") >= fewest))
    joined = words.join(near_words(words, most, shortest), "word", "left")
    far = F.col("near_n") >= ratio * F.col("n")
    formed = folder.write(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("near")).alias("form"), F.when(far, F.col("near_n")).alias("form_n")))
    # a form is far more frequent, so chains are short and have no loops; each round doubles what is followed
    links = folder.write(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, links = links, folder.write(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        going = not links.filter("went").isEmpty()
        folder.drop(before)
        links = links.drop("went") if not going else folder.write(links.drop("went"))
        if not going:
            break
    found = formed.join(links, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
