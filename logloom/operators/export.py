"""Vocabulary and facts distilled from a digest and a profile."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import lexicon as lx
from logloom.functions import text as tx

CJK_LEAST, ENGLISH_LEAST, MOST_TERMS, MOST_TOPICS, MOST_FACTS, PER_GROUP = 10, 3, 60, 4, 14, 8


def proper_nouns(prompts: DataFrame) -> DataFrame:
    """(term, weight) of English proper nouns in prompts(prompt, n), each occurrence weighted by n."""
    found = F.regexp_extract_all("prompt", F.lit("(?U)" + lx.PROPER_NOUN), F.lit(1))
    terms = prompts.select("n", F.explode(found).alias("term")).filter(~F.col("term").isin(lx.ENGLISH_COMMON) & F.length("term").between(2, 30))
    return terms.groupBy("term").agg(F.sum("n").alias("weight"))


def cjk_grams(prompts: DataFrame) -> DataFrame:
    """(term, weight) of 2- to 4-character grams of CJK runs, each once for a run, weighted by n."""
    runs = prompts.select("n", F.explode(F.regexp_extract_all("prompt", F.lit(lx.CJK_RUN), F.lit(0))).alias("run"))

    def grams(k: int):
        at = F.when(F.length("run") >= k, F.sequence(F.lit(1), F.length("run") - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(F.col("run"), i, F.lit(k)))

    each = F.array_distinct(F.concat(grams(4), grams(3), grams(2)))
    terms = runs.select("n", F.explode(each).alias("term")).filter(~F.col("term").isin(lx.CJK_COMMON))
    return terms.groupBy("term").agg(F.sum("n").alias("weight"))


def longest_only(grams: DataFrame, least: int = CJK_LEAST, ratio: float = 1.5, longest: int = 4) -> DataFrame:
    """Grams of at least the least weight that no longer kept gram contains with a weight close to theirs.

    Level by level from the longest; a gram's parts are generated, so each
    level is an equality join.
    """
    strong = grams.filter(F.col("weight") >= least)
    kept = strong.filter(F.length("term") >= longest)
    for k in range(longest - 1, 0, -1):
        parts = kept.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - k + 1), lambda i: F.substring(F.col("term"), i, F.lit(k)))).alias("term"), F.col("weight").alias("over"))
        top = parts.groupBy("term").agg(F.max("over").alias("over"))
        level = strong.filter(F.length("term") == k).join(top, "term", "left")
        kept = kept.union(level.filter(F.col("over").isNull() | (F.col("weight") > F.col("over") * ratio)).select("term", "weight"))
    return kept


def project_terms(projects: DataFrame) -> DataFrame:
    """(term, weight) of clean project names of projects(cwd, sessions)."""
    named = projects.select(tx.clean_basename(F.col("cwd")).alias("term"), F.coalesce("sessions", F.lit(1)).alias("sessions"))
    return named.filter("term is not null").groupBy("term").agg(F.sum("sessions").alias("weight"))


def terms(projects: DataFrame, prompts: DataFrame, k: int = MOST_TERMS) -> DataFrame:
    """The k heaviest terms: project names, proper nouns and CJK grams; ties by term."""
    english = proper_nouns(prompts).filter(F.col("weight") >= ENGLISH_LEAST)
    both = project_terms(projects).unionByName(english).unionByName(longest_only(cjk_grams(prompts)))
    return both.groupBy("term").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "term").limit(k)


def merged_counts(installs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, installs, mentions): full outer join of two counters, missing ones 0."""
    a, b = installs.select("name", F.col("n").alias("installs")), mentions.select("name", F.col("n").alias("mentions"))
    return a.join(b, "name", "full").select("name", F.coalesce("installs", F.lit(0)).alias("installs"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


def stack(installs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(grp, grp_order, displays): known technologies installed once or mentioned twice, best first, PER_GROUP of a group."""
    spark = installs.sparkSession
    known = [(t, g, i, d) for i, (g, own) in enumerate(lx.STACK.items()) for t, d in own]
    table = F.broadcast(spark.createDataFrame(known, "name string, grp string, grp_order int, display string"))
    ranked = merged_counts(installs, mentions).filter("installs >= 1 or mentions >= 2").join(table, "name").withColumn("score", F.col("installs") * 3 + F.col("mentions"))
    first = ranked.groupBy("display", "grp", "grp_order").agg(F.max("score").alias("score"), F.min_by("name", F.struct(-F.col("score"), "name")).alias("name"))
    nth = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "name"))
    best = first.withColumn("nth", nth).filter(F.col("nth") <= PER_GROUP)
    return best.groupBy("grp", "grp_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "display"))), lambda x: x["display"]).alias("displays")).orderBy("grp_order")


def main_languages(extensions: DataFrame, k: int = 5) -> DataFrame:
    """The k languages whose extensions(ext, n) count most, each once."""
    table = F.broadcast(extensions.sparkSession.createDataFrame(lx.LANGUAGES, "ext string, language string"))
    named = extensions.select(F.lower("ext").alias("ext"), "n").join(table, "ext")
    return named.groupBy("language").agg(F.max(F.struct("n", "ext")).alias("best")).orderBy(F.desc("best.n"), "language").limit(k).select("language")


def main_projects(projects: DataFrame, least: float = 0.02, k: int = 5) -> DataFrame:
    named = projects.filter(F.col("share") >= least).select(tx.clean_basename(F.col("cwd")).alias("name"), "share").filter("name is not null")
    return named.groupBy("name").agg(F.max("share").alias("share")).orderBy(F.desc("share"), "name").limit(k)


def style_facts(style: DataFrame) -> DataFrame:
    """(nth, fact) of the rules of lexicon.STYLE_RULES that hold for a one-row frame of shares."""
    held = F.array(*[F.struct(F.lit(n).alias("nth"), F.when(F.expr(rule), fact).alias("fact")) for n, (rule, fact) in enumerate(lx.STYLE_RULES)])
    return style.select(F.explode(held).alias("r")).select("r.*").filter("fact is not null")


def style_frame(spark: SparkSession, style: dict[str, Any]) -> DataFrame:
    """A profile's prompting style as one row."""
    mix = style.get("length_mix") or {}
    row = (float(style.get("cjk_share") or 0), mix.get("terse (<40)", 0) / max(1, sum(mix.values())), float(style.get("median_chars") or 0), float(style.get("acceptance_rate") or 0), float(style.get("discuss_first_rate") or 0))
    return spark.createDataFrame([row], "cjk_share double, terse_share double, median_chars double, acceptance_rate double, discuss_first_rate double")


def topics(projects: DataFrame, least: float = 0.03, k: int = MOST_TOPICS) -> DataFrame:
    named = projects.filter(F.col("share") >= least).select(tx.clean_basename(F.col("cwd")).alias("name"), "share").filter("name is not null")
    line = F.format_string(lx.TOPIC_SENTENCE, F.col("name"), F.bround(F.col("share") * 100).cast("int").cast("string"))
    return named.orderBy(F.desc("share"), "name").limit(k).select(line.alias("topic"))


def build(spark, digest: dict[str, Any], profile: dict[str, Any] | None, schema: str = "input-profile/v2", source: str = "logloom") -> dict[str, Any]:
    """The export document; without a profile only what the digest gives."""
    projects = spark.createDataFrame([(p["cwd"], p.get("sessions", 1), float(p.get("share", 0))) for p in digest.get("projects", [])], "cwd string, sessions long, share double")
    prompts = spark.createDataFrame([(p.get("prompt") or "", p.get("n", 1)) for p in digest.get("task_prompts", [])], "prompt string, n long")
    facts: list[dict[str, str]] = []

    def counter(items: list[dict[str, Any]]) -> DataFrame:
        return spark.createDataFrame([(i["name"].lower(), int(i.get("n", 1))) for i in items], "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))

    if profile:
        f = profile["stack_fingerprint"]
        for r in stack(counter(f["packages_installed"]), counter(f["libs_mentioned"])).collect():
            facts.append({"topic": lx.FACT_TOPICS["stack"], "fact": lx.STACK_SENTENCE % (r["grp"], " · ".join(r["displays"]))})
    ext = (profile or {}).get("stack_fingerprint", {}).get("languages") or digest.get("edited_filetypes") or {}
    langs = [r["language"] for r in main_languages(spark.createDataFrame(list(ext.items()), "ext string, n long")).collect()]
    if langs:
        facts.append({"topic": lx.FACT_TOPICS["language"], "fact": lx.LANGUAGE_SENTENCE % " · ".join(langs)})
    names = [r["name"] for r in main_projects(projects).collect()]
    if names:
        facts.append({"topic": lx.FACT_TOPICS["project"], "fact": lx.PROJECT_SENTENCE % " · ".join(names)})
    if profile:
        own = style_facts(style_frame(spark, profile["prompting_style"])).orderBy("nth").collect()
        facts += [{"topic": lx.FACT_TOPICS["style"], "fact": r["fact"]} for r in own]
    return {
        "schema": schema,
        "source": source,
        "terms": [{"term": r["term"], "weight": r["weight"]} for r in terms(projects, prompts).collect()],
        "facts": list({f["fact"]: f for f in facts}.values())[:MOST_FACTS],
        "topics": [r["topic"] for r in topics(projects).collect()],
    }
