"""Digests from mergeable partial aggregates.

A partial is one long table: for each metric and key a count, and for some the
first row in order with its text and source.  Counts add up and first rows
merge by their order, so the partials of disjoint sets of sessions merge into
that of all.  Lengths of prompts are kept as a histogram, from which the
median is exact.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import lexicon as lx
from logloom.functions import text as tx
from logloom.operators.digest import WORK
from logloom.operators.sessions import Tables

SCHEMA = "part int, metric string, key string, n long, at struct<ts: string, session_id: string, seq: long>, text string, source string"
#: Rows of each metric that a digest shows; of others all.
LIMITS = {"project": 15, "tool": 25, "command": 25, "extension": 15, "quote": 40, "task": 60}
#: Between the parts of a key.
CUT = "\x1f"


def partial(t: Tables, part: Column) -> DataFrame:
    """Rows of SCHEMA for the tables' sessions; ``part`` is an expression over session_id that keeps sessions apart."""
    session = t.session.withColumnRenamed("id", "session_id").withColumn("part", part)
    work, real = session.filter(F.col("kind").isin(WORK)), session.filter("kind = 'real'")
    said = t.message.join(real.select("session_id", "part", "source"), "session_id").filter("role = 'user'")
    used = t.tool_call.join(work.select("session_id", "part"), "session_id")
    at, when = F.struct("ts", "session_id", "seq"), tx.parse_ts(F.col("ts"))
    texts = said.filter("text is not null")

    def counted(rows: DataFrame, metrics: dict[str, Column], n: Column | None = None) -> DataFrame:
        """Counts of several keys in one pass; null keys count nowhere."""
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), k.cast("string").alias("key")) for m, k in metrics.items()])
        each = rows.select("part", (F.lit(1) if n is None else n).alias("_n"), F.explode(pairs).alias("p")).select("part", "_n", "p.*").filter("key is not null")
        return each.groupBy("part", "metric", "key").agg(F.sum("_n").cast("long").alias("n"))

    def firsts(rows: DataFrame, metric: str, key: Column, text: Column) -> DataFrame:
        """Counts and first rows of a key."""
        own = rows.select("part", key.alias("key"), at.alias("at"), text.alias("text"), "source")
        return own.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.min_by(F.struct("text", "source"), "at").alias("f")).select("part", F.lit(metric).alias("metric"), "key", "n", "at", "f.text", "f.source")

    style = {"cjk": F.col("text").rlike(lx.CJK), "acceptance": tx.has_acceptance(F.col("text")), "discussion": tx.wants_discussion(F.col("text"))}
    counts = [
        counted(session, {"kind": F.concat_ws(CUT, "source", "kind")}),
        counted(session, {"tokens": F.col("source")}, F.coalesce("out_tokens", F.lit(0))),
        counted(work, {"project": F.col("project"), "model": F.col("model")}),
        counted(used, {"tool": F.col("tool"), "command": F.col("cmd_key"), "extension": F.col("file_ext")}),
        counted(said, {"hour": F.hour(when), "weekday": F.weekday(when), "day": F.to_date(when)}),
        counted(texts, {"length": F.length("text")} | {f"style{CUT}{k}": F.when(c, "1") for k, c in style.items()}),
    ]
    out = firsts(texts.filter("is_friction"), "quote", F.substring("text", 1, 180), F.lit(None).cast("string"))
    out = out.unionByName(firsts(texts.filter("is_task and sig is not null"), "task", F.col("sig"), F.substring("text", 1, 160)))
    for c in counts:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.select("part", "metric", "key", "n", "at", "text", "source")


def merged(partials: DataFrame) -> DataFrame:
    """metric, key, n, at, text, source over all parts."""
    both = partials.groupBy("metric", "key").agg(F.sum("n").alias("n"), F.min("at").alias("at"), F.min_by(F.struct("text", "source"), "at").alias("f"))
    return both.select("metric", "key", "n", "at", "f.text", "f.source")


def shown(rows: DataFrame) -> DataFrame:
    """Of each metric the rows that a digest shows, with nth: quotes by their first occurrence, others by count, ties by it or by key."""
    order = [F.when(F.col("metric") == "quote", 0).otherwise(-F.col("n")), F.col("at"), F.col("key")]
    nth = F.row_number().over(Window.partitionBy("metric").orderBy(*order))
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv]), F.col("metric")), F.lit(1 << 30))
    few = rows.filter((F.col("metric") != "length") & (F.col("metric") != "day"))
    return few.withColumn("nth", nth).filter(F.col("nth") <= limit)


def digest(rows: DataFrame, notes: str = "estimated from assistant usage records") -> dict[str, Any]:
    """The document that digest.build makes, from merged partials."""
    own: dict[str, list[Any]] = {}
    for r in shown(rows).orderBy("metric", "nth").collect():  # bounded by LIMITS, or by the number of sources, models, hours
        own.setdefault(r["metric"], []).append(r)
    days = rows.filter("metric = 'day'").agg(F.min("key"), F.max("key")).first()
    kinds: dict[str, dict[str, int]] = {}
    for r in own.get("kind", []):
        source, kind = r["key"].split(CUT)
        kinds.setdefault(source, {"real": 0, "meta": 0, "artifact": 0})[kind] = r["n"]
    kinds = {s: kinds[s] for s in sorted(kinds)}
    work = max(1, sum(k["real"] + k["meta"] for k in kinds.values()))

    def counts(metric: str) -> dict[str, int]:
        return {r["key"]: r["n"] for r in own.get(metric, [])}

    def dense(metric: str, size: int) -> list[int]:
        found = counts(metric)
        return [found.get(str(i), 0) for i in range(size)]

    return {
        "meta": {
            "sources": list(kinds),
            "sessions": sum(k["real"] for k in kinds.values()),
            "meta_sessions_skipped": {s: k["meta"] for s, k in kinds.items()},
            "artifact_sessions_skipped": {s: k["artifact"] for s, k in kinds.items()},
            "tokens_note": notes,
            "span": list(days),
        },
        "temporal": {"by_hour": dense("hour", 24), "by_weekday": dense("weekday", 7)},
        "projects": [{"cwd": k, "sessions": n, "share": round(n / work, 3)} for k, n in counts("project").items()],
        "tools_used": counts("tool"),
        "commands_top": [{"cmd": k, "n": n} for k, n in counts("command").items()],
        "edited_filetypes": counts("extension"),
        "models": counts("model"),
        "output_tokens_est": counts("tokens"),
        "friction_candidates": [{"source": r["source"], "session": r["at"]["session_id"], "quote": r["key"]} for r in own.get("quote", [])],
        "task_prompts": [{"prompt": r["text"], "n": r["n"], "source": r["source"]} for r in own.get("task", [])],
        "per_source": {s: k["real"] for s, k in kinds.items()},
    }


def style(rows: DataFrame) -> DataFrame:
    """The one row of habits.style, from merged partials: the median by the running count of lengths."""
    lengths = rows.filter("metric = 'length'").select(F.col("key").cast("int").alias("length"), "n")
    so_far = lengths.withColumn("upto", F.sum("n").over(Window.orderBy("length")))  # as many rows as lengths, TEXT_LIMIT at most
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_prompts"))
    lower, upper = F.floor((F.col("n_prompts") + 1) / 2), F.floor(F.col("n_prompts") / 2) + 1
    both = so_far.crossJoin(F.broadcast(total))
    median = both.agg((F.min(F.when(F.col("upto") >= lower, F.col("length"))) + F.min(F.when(F.col("upto") >= upper, F.col("length")))) / 2)
    shares = rows.agg(*[F.coalesce(F.sum(F.when(F.col("metric") == f"style{CUT}{k}", F.col("n"))), F.lit(0)).alias(k) for k in ("cjk", "acceptance", "discussion")])
    one = total.crossJoin(median.toDF("median")).crossJoin(shares)
    share = lambda c: (F.col(c) / F.greatest(F.lit(1), "n_prompts")).cast("double")
    return one.select("n_prompts", F.coalesce(F.col("median").cast("double"), F.lit(0.0)).alias("median_chars"), share("cjk").alias("cjk_share"), share("acceptance").alias("acceptance_rate"), share("discussion").alias("discuss_first_rate"))
