"""An inverted index of trigrams with their positions, and phrase search on it.

A phrase occurs at position p of a text exactly where each of its trigrams
occurs at p plus its own place in the phrase.  Trigrams three places apart,
and the last one, cover the phrase; only their postings are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.search import B, K1

GRAM = 3


def length(text: Column) -> Column:
    """A text's length for the rank: its number of trigrams."""
    return F.greatest(F.lit(0), F.length(text) - (GRAM - 1))


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def postings(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """gram, the columns of key, pos, d: every trigram of every text that isn't null, with the text's number of trigrams.

    Nothing is shuffled; a text's rows come one after the other.
    """
    # the characters are a column of their own, so that no use of them cuts the text again
    cut = rows.filter(F.col(text).isNotNull()).select(*key, length(F.col(text)).alias("d"), F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?s)."), F.lit(0)).alias("_chars"))
    starts = F.when(F.size("_chars") >= GRAM, F.sequence(F.lit(0), F.size("_chars") - GRAM)).otherwise(F.array().cast("array<int>"))
    own = F.transform(starts, lambda i: F.concat(*[F.get("_chars", i + k) for k in range(GRAM)]))
    return cut.select(*key, "d", F.posexplode(own).alias("pos", "gram"))


def covering(phrase: str) -> dict[str, list[int]]:
    """Trigrams that cover a phrase of three characters or more, each with its places."""
    folded = phrase.lower()
    last = len(folded) - GRAM
    places: dict[str, list[int]] = {}
    for at in [*range(0, last, GRAM), last]:
        places.setdefault(folded[at : at + GRAM], []).append(at)
    return places


def phrase_counts(found: DataFrame, key: list[str], phrase: str) -> DataFrame:
    """The columns of key, f, d: how often the phrase occurs in each text that holds it, overlaps included.

    found has the postings of the phrase's covering trigrams, or more.
    """
    places = covering(phrase)
    wanted = sum(len(p) for p in places.values())
    table = F.create_map(*[x for g, own in places.items() for x in (F.lit(g), F.array(*[F.lit(p) for p in own]))])
    own = found.filter(F.col("gram").isin(*places))
    starts = own.select(*key, "d", F.explode(F.transform(F.element_at(table, F.col("gram")), lambda p: F.col("pos") - p)).alias("_start"))
    whole = starts.groupBy(*key, "d", "_start").agg(F.count("*").alias("_n")).filter(F.col("_n") == wanted)
    return whole.groupBy(*key, "d").agg(F.count("*").alias("f"))


def ranked(counts: DataFrame, rows: Column, hits: Column, avg_d: Column) -> DataFrame:
    """counts(f, d) with rank, the negated BM25 score, from the number of texts, that of hits, and the mean of d."""
    idf = F.log((rows - hits + 0.5) / (hits + 0.5))
    weight = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return counts.withColumn("rank", -weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / avg_d)))


def phrase_hits(rows: DataFrame, key: list[str], phrase: str, text: str = "text") -> DataFrame:
    """The columns of key, f, d, rank of texts that hold a phrase, from postings made on the way."""
    counts = phrase_counts(postings(rows, key, text), key, phrase)
    stats = rows.filter(F.col(text).isNotNull()).agg(F.count("*").alias("_rows"), F.avg(length(F.col(text))).alias("_avg"))
    hits = counts.agg(F.count("*").alias("_hits"))
    with_stats = counts.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(hits))
    return ranked(with_stats, F.col("_rows"), F.col("_hits"), F.col("_avg")).drop("_rows", "_hits", "_avg")
