"""Substring search with BM25 ranks, and packing of hits into a token budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as tx

K1, B = 1.2, 0.75


def overlapping_count(text: Column, query: str) -> Column:
    """Occurrences of query in text, case-folded, overlaps included."""
    return F.regexp_count(F.lower(text), F.lit("(?=" + re.escape(query.lower()) + ")"))


def short_match(text: Column, query: str) -> Column:
    """Matching of queries under three characters: ASCII case folded, % and _ as wildcards; an empty query matches all."""
    return text.ilike(f"%{query}%")


def bm25(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows that hold query, with rank: the negated BM25 score of the query as a phrase of trigrams (smaller is better).

    The document length is its number of trigrams; N counts all rows; one
    aggregate over the table gives the statistics, which a broadcast of that
    single row brings to the hits.
    """
    d = F.greatest(F.lit(0), F.length(text) - 2)
    marked = rows.withColumn("f", overlapping_count(F.col(text), query)).withColumn("d", d)
    stats = marked.agg(F.count("*").alias("rows"), F.count_if(F.col("f") > 0).alias("hits"), F.avg("d").alias("avg_d"))
    idf = F.log((F.col("rows") - F.col("hits") + 0.5) / (F.col("hits") + 0.5))
    weight = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    score = -weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))
    return marked.filter(F.col("f") > 0).crossJoin(F.broadcast(stats)).withColumn("rank", score).drop("f", "d", "rows", "hits", "avg_d")


def search(rows: DataFrame, query: str, limit: int = 20, text: str = "text", id: str = "id", recent: str | None = None) -> DataFrame:
    """The best rows: by rank, or for queries under three characters the latest ones; ties by id."""
    if len(query) < 3:
        order = [F.desc(recent)] if recent else []
        return rows.filter(short_match(F.col(text), query)).orderBy(*order, id).limit(limit)
    return bm25(rows, query, text).orderBy("rank", id).limit(limit)


def pack(hits: DataFrame, budget: int, order: list[str], text: str = "text", width: int = 500) -> DataFrame:
    """The longest run of ranked hits whose excerpts' estimated tokens stay within the budget; hits are bounded by a limit."""
    cost = hits.withColumn("excerpt", F.substring(text, 1, width)).withColumn("cost", tx.token_cost(F.col("excerpt")))
    running = F.sum("cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cost.withColumn("used", running).filter(F.col("used") <= budget)


def session_hits(message: DataFrame, session: DataFrame, query: str, kinds: tuple[str, ...] = ("real", "meta")) -> tuple[DataFrame, list[Column | str]]:
    """Messages that hold query, of sessions of these kinds, with session, source and project; and the order of hits.

    White space around the query doesn't count.  Ranks come from the statistics
    of all messages, as an index over them would give them; hits of queries
    under three characters have none, and the latest come first.
    """
    query = query.strip()
    own = session.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("session_id"), "source", "project")
    rows = message.filter("text is not null").withColumn("id", F.struct("session_id", "seq"))
    if len(query) < 3:
        found, order = rows.filter(short_match(F.col("text"), query)), [F.desc("ts"), "id"]
    else:
        found, order = bm25(rows, query), ["rank", "id"]
    return found.join(own, "session_id").withColumn("session", F.col("session_id")), order


def session_search(message: DataFrame, session: DataFrame, query: str, limit: int = 20, kinds: tuple[str, ...] = ("real", "meta")) -> DataFrame:
    """The best hits: session, source, project, ts, text."""
    found, order = session_hits(message, session, query, kinds)
    return found.orderBy(*order).limit(limit).select("session", "source", "project", "ts", "text")


def session_pack(message: DataFrame, session: DataFrame, query: str, budget: int, limit: int = 200) -> tuple[DataFrame, int]:
    """Excerpts of the best hits within the budget, in their order (session, source, project, ts, excerpt, used), and the number of hits."""
    found, order = session_hits(message, session, query)
    hits = found.orderBy(*order).limit(limit)
    packed = pack(hits, budget, order).orderBy("used", *order)
    return packed.select("session", "source", "project", "ts", "excerpt", "used"), hits.count()
