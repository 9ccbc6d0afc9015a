"""Habit profile: prompting style, technologies, verification habits, themes of corrections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import lexicon as lx
from logloom.functions import text as tx
from logloom.operators.digest import WORK, top_counts
from logloom.operators.sessions import Tables


def style(prompts: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_prompts, the exact median length, and the shares of prompts with CJK, acceptance criteria, discussion first."""
    c = F.col(text)

    def share(x: Column) -> Column:
        return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))

    return prompts.filter(c.isNotNull()).agg(
        F.count("*").alias("n_prompts"),
        F.coalesce(F.percentile(F.length(c), 0.5), F.lit(0.0)).alias("median_chars"),
        share(c.rlike(lx.CJK)).alias("cjk_share"),
        share(tx.has_acceptance(c)).alias("acceptance_rate"),
        share(tx.wants_discussion(c)).alias("discuss_first_rate"),
    )


def length_mix(prompts: DataFrame, text: str = "text") -> DataFrame:
    return prompts.filter(F.col(text).isNotNull()).groupBy(tx.length_class(F.col(text)).alias("length_class")).agg(F.count("*").alias("n"))


def exploded_counts(rows: DataFrame, items: Column, name: str, k: int | None = None) -> DataFrame:
    """Counts of the items of an array column, most frequent first, ties by name."""
    return top_counts(rows.select(F.explode(items).alias(name)), name, k)


def themes(rows: DataFrame, text: str, rules: list[tuple[str, str]], other: str, order: list[str], quotes: int = 3, width: int = 140, flags: str = "(?i)") -> DataFrame:
    """theme, n and the first distinct quotes in order; themes by count, ties by first occurrence."""
    marked = rows.select(tx.first_match(F.col(text), rules, other, flags).alias("theme"), F.substring(text, 1, width).alias("quote"), F.struct(*order).alias("at"))
    counts = marked.groupBy("theme").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    distinct = marked.groupBy("theme", "quote").agg(F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("theme").orderBy("at", "quote"))
    kept = distinct.withColumn("nth", nth).filter(F.col("nth") <= quotes)
    lists = kept.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "quote"))), lambda x: x["quote"]).alias("quotes"))
    return counts.join(lists, "theme").orderBy(F.desc("n"), "at").select("theme", "n", "quotes")


def verification(calls: DataFrame) -> DataFrame:
    """One row: commands by bucket, commits, edits, and tests for each edit (null without edits)."""
    bucket = tx.verification(F.col("cmd_key"))
    counts = [F.count_if(bucket == name).alias(name) for name, _ in lx.VERIFICATION]
    commits = F.count_if(F.lower("cmd_key").startswith("git commit")).alias("commits")
    edits = F.count_if(F.col("tool").isin(lx.EDIT_TOOLS)).alias("edits")
    return calls.agg(*counts, commits, edits).withColumn("test_to_edit_ratio", F.try_divide("test", "edits"))


def build(t: Tables) -> dict[str, Any]:
    """The profile document."""
    ids = F.col("id").alias("session_id")
    real = t.session.filter("kind = 'real'").select(ids, "source")
    work = t.session.filter(F.col("kind").isin(WORK)).select(ids)
    said = t.message.join(real, "session_id").filter("role = 'user' and text is not null")
    used = t.tool_call.join(work, "session_id")
    s = style(said).first()
    v = verification(used).first()
    friction = said.filter("is_friction").select("text", "ts", "session_id", "seq")
    found = themes(friction, "text", lx.PROFILE_THEMES, lx.PROFILE_OTHER, ["ts", "session_id", "seq"])
    ratio = v["test_to_edit_ratio"]

    def named(df: DataFrame, key: str) -> list[dict[str, Any]]:
        return [{"name": r[key], "n": r["n"]} for r in df.collect()]

    managers = top_counts(used.filter("pkgs is not null").select(tx.manager(F.col("cmd_key")).alias("manager")), "manager")
    return {
        "prompting_style": {
            "n_prompts": s["n_prompts"],
            "median_chars": round(s["median_chars"], 1),
            "length_mix": {r["length_class"]: r["n"] for r in length_mix(said).collect()},
            "cjk_share": round(s["cjk_share"], 3),
            "acceptance_rate": round(s["acceptance_rate"], 3),
            "discuss_first_rate": round(s["discuss_first_rate"], 3),
        },
        "stack_fingerprint": {
            "packages_installed": named(exploded_counts(used, F.col("pkgs"), "package", 25), "package"),
            "libs_mentioned": named(exploded_counts(said, tx.libraries(F.col("text")), "library", 25), "library"),
            "package_managers": {r["manager"]: r["n"] for r in managers.collect()},
            "languages": {r["file_ext"]: r["n"] for r in top_counts(used, "file_ext", 15).collect()},
        },
        "verification_habits": {
            "buckets": {name: v[name] for name, _ in lx.VERIFICATION if v[name]},
            "commits": v["commits"],
            "edits": v["edits"],
            "test_to_edit_ratio": round(ratio, 3) if ratio is not None else None,
        },
        "friction_themes": [r.asDict() for r in found.collect()],
    }

