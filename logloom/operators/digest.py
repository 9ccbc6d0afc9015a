"""Digest: counts, shares and exemplars over sessions, messages and tool calls."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators.sessions import Tables

WORK = ["real", "meta"]


def top_counts(df: DataFrame, key: str, k: int | None = None, name: str = "n") -> DataFrame:
    """Rows for each non-null key, most frequent first, ties by key."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)
    return out.limit(k) if k else out


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds share, the part of the sum of all rows."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(*counts.columns, (F.col(n) / F.greatest(F.lit(1), "_total")).alias("share"))


def with_remainder(shares: DataFrame, key: str, k: int, other: str = "other") -> DataFrame:
    """The k rows with the largest share, and one for all others."""
    best = shares.orderBy(F.desc("share"), key).limit(k).select(key, "share")
    rest = shares.join(F.broadcast(best.select(key)), key, "left_anti").agg(F.sum("share").alias("share")).filter("share is not null")
    return best.unionByName(rest.select(F.lit(other).alias(key), "share"))


def by_source_kind(session: DataFrame) -> DataFrame:
    return session.groupBy("source", "kind").agg(F.count("*").alias("n"))


def kind_pivot(session: DataFrame) -> DataFrame:
    """Sessions of each kind by source, 0 where there is none."""
    return session.groupBy("source").pivot("kind", ["real", "meta", "artifact"]).agg(F.count(F.lit(1))).na.fill(0)


def totals_by_source(session: DataFrame, sums: dict[str, str]) -> DataFrame:
    """source, the sum of each named column (0 where all are null), and the number of sessions."""
    return session.groupBy("source").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()], F.count("*").alias("sessions"))


def histogram(values: DataFrame, c: Column, size: int, name: str) -> DataFrame:
    """Dense counts of 0 .. size - 1; nulls are skipped."""
    spark = values.sparkSession
    found = values.select(c.cast("int").alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return spark.range(size).select(F.col("id").cast("int").alias(name)).join(found, name, "left").na.fill(0, ["n"])


def by_hour(values: DataFrame, ts: Column) -> DataFrame:
    return histogram(values, F.hour(ts), 24, "hour")


def by_weekday(values: DataFrame, ts: Column) -> DataFrame:
    """Monday is 0."""
    return histogram(values, F.weekday(ts), 7, "weekday")


def peak(counts: DataFrame, key: str) -> DataFrame:
    """The key with the largest count, the first of equals."""
    return counts.agg(F.max_by(key, F.struct("n", (-F.col(key)).alias("k"))).alias(key))


def span(values: DataFrame, ts: Column) -> DataFrame:
    return values.agg(F.min(F.to_date(ts)).alias("first_day"), F.max(F.to_date(ts)).alias("last_day"))


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order; partial aggregation, so a frequent key costs little."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.groupBy(F.col(key).alias("_key")).agg(first).select("r.*")


def groups_by_signature(rows: DataFrame, *order: str) -> DataFrame:
    """sig, n, and text and source of the first row of each signature in order."""
    at = F.struct(*order)
    return rows.filter("sig is not null").groupBy("sig").agg(F.count("*").alias("n"), F.min_by(F.substring("text", 1, 160), at).alias("prompt"), F.min_by("source", at).alias("source"), F.min(at).alias("at"))


def build(t: Tables, notes: str = "estimated from assistant usage records") -> dict[str, Any]:
    """The digest document.  Everything collected is bounded by a limit or by the number of sources and models."""
    real, work = t.session.filter("kind = 'real'"), t.session.filter(F.col("kind").isin(WORK))
    ids = F.col("id").alias("session_id")
    said = t.message.join(real.select(ids, "source", "project"), "session_id").filter("role = 'user'")
    used = t.tool_call.join(work.select(ids), "session_id")
    ts = tx.parse_ts(F.col("ts"))
    pivot = {r["source"]: r for r in kind_pivot(t.session).orderBy("source").collect()}
    order = ("ts", "session_id", "seq")

    def counts(df: DataFrame, key: str, k: int | None) -> dict[str, int]:
        return {r[key]: r["n"] for r in top_counts(df, key, k).collect()}

    friction = said.filter("is_friction and text is not null").withColumn("quote", F.substring("text", 1, 180))
    candidates = first_of_each(friction.select("quote", "source", "session_id", "ts", "seq"), "quote", *order).orderBy(*order).limit(40)
    tasks = groups_by_signature(said.filter("is_task and text is not null"), *order).orderBy(F.desc("n"), "at").limit(60)
    days = span(said, ts).first()
    projects = with_share(top_counts(work, "project")).orderBy(F.desc("n"), "project").limit(15)
    tokens = totals_by_source(t.session, {"n": "out_tokens"}).collect()
    return {
        "meta": {
            "sources": sorted(pivot),
            "sessions": sum(r["real"] for r in pivot.values()),
            "meta_sessions_skipped": {k: r["meta"] for k, r in pivot.items()},
            "artifact_sessions_skipped": {k: r["artifact"] for k, r in pivot.items()},
            "tokens_note": notes,
            "span": [str(d) if d else None for d in days],
        },
        "temporal": {
            "by_hour": [r["n"] for r in by_hour(said, ts).orderBy("hour").collect()],
            "by_weekday": [r["n"] for r in by_weekday(said, ts).orderBy("weekday").collect()],
        },
        "projects": [{"cwd": r["project"], "sessions": r["n"], "share": round(r["share"], 3)} for r in projects.collect()],
        "tools_used": counts(used, "tool", 25),
        "commands_top": [{"cmd": r["cmd_key"], "n": r["n"]} for r in top_counts(used, "cmd_key", 25).collect()],
        "edited_filetypes": counts(used, "file_ext", 15),
        "models": counts(work, "model", None),
        "output_tokens_est": {r["source"]: r["n"] for r in tokens},
        "friction_candidates": [{"source": r["source"], "session": r["session_id"], "quote": r["quote"]} for r in candidates.collect()],
        "task_prompts": [{"prompt": r["prompt"], "n": r["n"], "source": r["source"]} for r in tasks.collect()],
        "per_source": {k: r["real"] for k, r in pivot.items()},
    }
