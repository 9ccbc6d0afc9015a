"""Queries that apply the operators to the tables of a data folder, with the same in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import lexicon as lx
from logloom.functions import text as tx
from logloom.operators import digest, export, habits, partials, postings, report, scans, search, sessions, similarity
from logloom.operators.scratch import Scratch
from logloom.plans import store
from logloom.sources import blocks, events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# words and prompts in SQL; RE2's classes suffice for these texts
SPACE = r"[\s\x0B]"
STOP = ", ".join(lit(w) for w in lx.STOP_WORDS)


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), {lit(lx.WORD)}), lambda w: w NOT IN ({STOP}))"


def sql_real(x: str) -> str:
    t = sql_trim(x)
    return f"(length({t}) >= 3 AND NOT (" + " OR ".join(f"starts_with({t}, {lit(p)})" for p in ["/", *lx.NOT_PROMPTS]) + "))"


def sql_injected(x: str) -> str:
    head = f"left(regexp_replace({x}, '^{SPACE}+', ''), 200)"
    return f"({x} = '' OR " + " OR ".join(f"contains({head}, {lit(m)})" for m in lx.INJECTED) + ")"


def sql_unwrap(x: str) -> str:
    cases = " ".join(f"WHEN contains({x}, {lit(w)}) THEN substr({x}, instr({x}, {lit(w)}) + {len(w)})" for w in lx.WRAPPERS)
    return sql_trim(f"regexp_replace(CASE {cases} ELSE {x} END, {lit(lx.LEADING_IMAGES)}, '')")


def sql_task(x: str) -> str:
    t = sql_trim(x)
    return f"({sql_real(x)} AND length({t}) >= 12 AND (regexp_matches({t}, {lit(lx.CJK)}) OR len(list_distinct({sql_words(t)})) >= 3))"


RECORDS = f"""
raw AS (SELECT conv_id, turn, role, text, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS kind,
  CASE WHEN role = 'user' AND NOT {sql_injected(sql_unwrap("text"))} AND {sql_real(sql_unwrap("text"))} THEN {sql_unwrap("text")} END AS prompt FROM conversations),
records AS (SELECT *,
  CAST(sum(CASE WHEN prompt IS NOT NULL OR kind = 'assistant' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS seq,
  coalesce(last_value(CASE WHEN kind <> 'other' THEN kind = 'assistant' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_assistant
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
turns AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'assistant' THEN seq END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS turn_seq FROM records),
rolled AS (SELECT 'conv:' || conv_id AS id, count(prompt) AS n_user, count(*) FILTER (kind = 'assistant') AS n_asst,
  coalesce(bool_or({sql_task("prompt")}), false) AS has_task FROM turns GROUP BY conv_id),
session AS (SELECT id, n_user, n_asst, CASE WHEN n_user = 0 THEN 'meta' WHEN NOT has_task THEN 'artifact' ELSE 'real' END AS kind FROM rolled WHERE n_user > 0 OR n_asst > 0)"""


def conversation_tables(spark: SparkSession, sf_dir: str) -> sessions.Tables:
    return sessions.build(sessions.from_conversations(table(spark, sf_dir, "conversations")), "chat", "conv", home="/home/nobody")


@query(f"WITH {RECORDS} SELECT 'chat' AS source, kind, count(*) AS n FROM session GROUP BY kind")
def session_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.by_source_kind(conversation_tables(spark, sf_dir).session)


@query(f"WITH {RECORDS} SELECT 'chat' AS source, count(*) FILTER (kind = 'real') AS \"real\", count(*) FILTER (kind = 'meta') AS meta, count(*) FILTER (kind = 'artifact') AS artifact FROM session")
def session_kind_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.kind_pivot(conversation_tables(spark, sf_dir).session)


@query(f"WITH {RECORDS} SELECT id, kind, n_user, n_asst FROM session")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_tables(spark, sf_dir).session.select("id", "kind", "n_user", "n_asst")


@query(f"WITH {RECORDS} SELECT conv_id, turn, seq, CAST(turn_seq AS BIGINT) AS turn_seq, after_assistant FROM turns")
def turn_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.sequenced(sessions.from_conversations(table(spark, sf_dir, "conversations")))
    return rows.select(F.col("file_path").cast("long").alias("conv_id"), F.col("line_no").alias("turn"), "seq", F.col("turn_seq").cast("long").alias("turn_seq"), "after_assistant")


@query(f"WITH {RECORDS} SELECT conv_id, turn, seq, CAST(turn_seq AS BIGINT) AS turn_seq, after_assistant FROM turns")
def turn_sequence_in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by segments of three turns, so that most sequences cross several of them."""
    rows = sessions.sequenced(sessions.from_conversations(table(spark, sf_dir, "conversations")), segment=3)
    return rows.select(F.col("file_path").cast("long").alias("conv_id"), F.col("line_no").alias("turn"), "seq", F.col("turn_seq").cast("long").alias("turn_seq"), "after_assistant")


@query(
    """SELECT event_id, CAST(sum(one) OVER w AS BIGINT) AS so_far, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bought
FROM (SELECT *, 1 AS one FROM events) WINDOW w AS (PARTITION BY user_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def running_values_of_long_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups hold all events: their running values come from segments, not from a window over a third of the table."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("grp"), "event_type")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return scans.carried(e, ["grp"], "event_id", 1000, {"so_far": F.lit(1)}, last_before={"bought": bought}).select("event_id", "so_far", "bought")


PATTERN = "and|the|que"


@query(f"WITH {RECORDS} SELECT conv_id, turn FROM turns WHERE prompt IS NOT NULL AND after_assistant AND length(prompt) < 600 AND regexp_matches(left(prompt, 120), '(?i){PATTERN}')")
def friction_after_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.sequenced(sessions.from_conversations(table(spark, sf_dir, "conversations"))).filter("prompt is not null")
    return rows.filter(tx.is_friction(F.col("prompt"), F.col("after_assistant"), PATTERN)).select(F.col("file_path").cast("long").alias("conv_id"), F.col("line_no").alias("turn"))


SIGNATURE = f"""
words AS (SELECT conv_id, turn, prompt, list_filter({sql_words("prompt")}, lambda w: length(w) >= 3) AS ws FROM turns WHERE prompt IS NOT NULL AND {sql_task("prompt")}),
each AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
ranked AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, min(i)) AS r FROM each GROUP BY conv_id, turn, w),
signed AS (SELECT conv_id, turn, string_agg(w, ' ' ORDER BY w) AS sig FROM ranked WHERE r <= 6 GROUP BY conv_id, turn),
tasks AS (SELECT 'conv:' || conv_id AS session_id, seq, left(prompt, 160) AS prompt, coalesce(sig, '') AS sig FROM words JOIN turns USING (conv_id, turn, prompt) LEFT JOIN signed USING (conv_id, turn))"""


@query(f"WITH {RECORDS}, {SIGNATURE} SELECT session_id, seq, sig FROM tasks")
def task_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_tables(spark, sf_dir).message.filter("is_task").select("session_id", "seq", "sig")


@query(f"WITH {RECORDS}, {SIGNATURE} SELECT sig, count(*) AS n, arg_min(prompt, (session_id, seq)) AS prompt FROM tasks GROUP BY sig")
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = conversation_tables(spark, sf_dir).message.filter("is_task").withColumn("source", F.lit("chat"))
    return digest.groups_by_signature(m, "session_id", "seq").select("sig", "n", "prompt")


@query("SELECT CAST(h AS INTEGER) AS hour, count(event_id) AS n FROM range(24) t(h) LEFT JOIN events ON hour(ts) = h GROUP BY h")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.by_hour(table(spark, sf_dir, "events"), F.col("ts"))


@query("SELECT CAST(d AS INTEGER) AS weekday, count(event_id) AS n FROM range(7) t(d) LEFT JOIN events ON isodow(ts) - 1 = d GROUP BY d")
def events_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.by_weekday(table(spark, sf_dir, "events"), F.col("ts"))


@query("SELECT CAST(h AS INTEGER) AS hour FROM (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, h LIMIT 1)")
def peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.peak(digest.by_hour(table(spark, sf_dir, "events"), F.col("ts")), "hour")


@query("SELECT CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day FROM events")
def event_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.span(table(spark, sf_dir, "events"), F.col("ts")).select(F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 15")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.top_counts(table(spark, sf_dir, "documents"), "source", 15)


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_share(digest.top_counts(table(spark, sf_dir, "events"), "event_type"))


@query(
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), s AS (SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS r, sum(n) OVER () AS t FROM c)
SELECT CASE WHEN r <= 6 THEN p_brand ELSE 'other' END AS p_brand, round(sum(n / t), 9) AS share FROM s GROUP BY 1"""
)
def brand_shares_with_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = digest.with_share(digest.top_counts(table(spark, sf_dir, "part"), "p_brand"))
    return digest.with_remainder(shares, "p_brand", 6).withColumn("share", F.round("share", 9))


@query("SELECT event_type, n, n / max(n) OVER () AS bar FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def relative_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.relative_to_max(digest.top_counts(table(spark, sf_dir, "events"), "event_type"))


@query("SELECT sum(CASE WHEN p_type LIKE '%BRASS' THEN n ELSE 0 END) / sum(n) AS share FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)")
def family_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = digest.top_counts(table(spark, sf_dir, "part"), "p_type").withColumnRenamed("p_type", "model")
    return report.family_share(models, "BRASS$")


@query(
    """SELECT user_id, greatest(0, max(CAST(floor(value) AS BIGINT))) AS highest, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, arg_max(event_type, (ts, event_id)) AS last_type,
  arg_min(CAST(ts AS VARCHAR), (ts, event_id)) AS first_ts FROM events GROUP BY user_id"""
)
def counters_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative counter's maximum beside the sum, and the last and first value in order."""
    v = F.floor("value").cast("long")
    at = F.struct("ts", "event_id")
    first = F.min_by(F.col("ts").cast("string"), at).alias("first_ts")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.greatest(F.lit(0), F.max(v)).alias("highest"), F.sum(v).alias("total"), F.max_by("event_type", at).alias("last_type"), first)


@query(
    """SELECT user_id, count(*) AS n FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE event_type = 'error' AND before = 'purchase' GROUP BY user_id"""
)
def errors_after_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("before", before).filter("event_type = 'error' and before = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")
    return table(spark, sf_dir, "events").select("event_id", "event_type", k)


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_each_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.first_of_each(table(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


STYLE = f"""SELECT count(*) AS n_prompts, CAST(median(length(text)) AS DOUBLE) AS median_chars, avg(CAST(regexp_matches(text, {lit(lx.CJK)}) AS INTEGER)) AS cjk_share,
  round(avg(CAST(regexp_matches(text, {lit("(?i)" + lx.ACCEPTANCE)}) AS INTEGER)), 9) AS acceptance_rate, avg(CAST(regexp_matches(text, {lit("(?i)" + lx.DISCUSS)}) AS INTEGER)) AS discuss_first_rate FROM documents"""


@query(STYLE)
def prompting_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.style(table(spark, sf_dir, "documents")).withColumn("acceptance_rate", F.round("acceptance_rate", 9))


@query("SELECT CASE WHEN length(text) < 40 THEN 'terse (<40)' WHEN length(text) > 400 THEN 'detailed (>400)' ELSE 'normal (40-400)' END AS length_class, count(*) AS n FROM documents GROUP BY 1")
def length_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.length_mix(table(spark, sf_dir, "documents"))


NAMES = ["trash", "clown", "the", "que"]


@query(
    """SELECT library, count(*) AS n FROM (SELECT DISTINCT doc_id, library FROM (SELECT doc_id, unnest(regexp_extract_all(
  regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_.-]+', '  ', 'g'), '(?:^| )(trash|clown|the|que)(?: |$)', 1)) AS library FROM documents)) GROUP BY 1"""
)
def names_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.exploded_counts(table(spark, sf_dir, "documents"), tx.libraries(F.col("text"), NAMES, {}), "library")


def sql_redacted(x: str) -> str:
    for pattern, to in lx.REDACTIONS:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return x


@query(f"SELECT doc_id, sha256({sql_redacted('text')}) AS redacted_sha FROM documents WHERE {sql_redacted('text')} <> text")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tx.redact(F.col("text"), "/home/nobody").alias("clean"))
    return docs.filter("clean <> text").select("doc_id", F.sha2("clean", 256).alias("redacted_sha"))


@query(
    r"""WITH b AS (SELECT regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS base FROM pages)
SELECT base AS term, count(*) AS weight FROM b WHERE length(base) >= 2 AND NOT starts_with(base, '.')
  AND NOT regexp_matches(base, '(?i)\.(app|md|json|html?|py|ts|js|mjs|txt|png|jpg|csv)$') AND lower(base) NOT IN ("""
    + ", ".join(lit(x) for x in lx.GENERIC_NAMES)
    + ") GROUP BY 1"
)
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.project_terms(table(spark, sf_dir, "pages").select(F.col("url").alias("cwd"), F.lit(1).alias("sessions")))


@query(
    # RE2's word boundary knows ASCII only: other letters become another word character
    f"""SELECT term, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT 1 AS n, unnest(regexp_extract_all(regexp_replace(text, '[ªµºÀ-ÖØ-öø-῿Ⰰ-퟿]', '_', 'g'), {lit(lx.PROPER_NOUN)}, 1)) AS term FROM documents)
WHERE length(term) BETWEEN 2 AND 30 AND term NOT IN ({", ".join(lit(w) for w in lx.ENGLISH_COMMON)}) GROUP BY 1"""
)
def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = table(spark, sf_dir, "documents").select(F.col("text").alias("prompt"), F.lit(1).alias("n"))
    return export.proper_nouns(prompts)


SEARCH = "tion"


@query(
    f"""WITH r AS (SELECT doc_id, length(text) AS len, len(list_filter(range(1, length(text) - {len(SEARCH) - 2}), lambda i: substr(lower(text), i, {len(SEARCH)}) = '{SEARCH}')) AS f FROM documents),
s AS (SELECT count(*) AS n, count(*) FILTER (f > 0) AS k, avg(greatest(0, len - 2)) AS a FROM r)
SELECT doc_id, round(-(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - k + 0.5) / (k + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(0, len - 2) / a)), 9) AS rank FROM r, s WHERE f > 0"""
)
def bm25_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), SEARCH).select("doc_id", F.round("rank", 9).alias("rank"))


PHRASE = "the that"


@query(
    f"""WITH r AS (SELECT doc_id, length(text) AS len, len(list_filter(range(1, length(text) - {len(PHRASE) - 2}), lambda i: substr(lower(text), i, {len(PHRASE)}) = {lit(PHRASE)})) AS f FROM documents),
s AS (SELECT count(*) AS n, count(*) FILTER (f > 0) AS k, avg(greatest(0, len - 2)) AS a FROM r)
SELECT doc_id, f, round(-(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - k + 0.5) / (k + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(0, len - 2) / a)), 9) AS rank FROM r, s WHERE f > 0"""
)
def posting_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.phrase_hits(table(spark, sf_dir, "documents"), ["doc_id"], PHRASE).select("doc_id", "f", F.round("rank", 9).alias("rank"))


@query(
    """WITH g AS (SELECT lower(text) AS t FROM conversations WHERE text IS NOT NULL),
e AS (SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM g)
SELECT gram, count(*) AS n FROM e GROUP BY gram"""
)
def posting_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.postings(table(spark, sf_dir, "conversations"), ["conv_id", "turn"]).groupBy("gram").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT doc_id, length(text) AS len, len(regexp_extract_all(lower(text), 'scum')) AS f FROM documents),
s AS (SELECT count(*) AS n, count(*) FILTER (f > 0) AS k, avg(greatest(0, len - 2)) AS a FROM r)
SELECT doc_id FROM r, s WHERE f > 0 ORDER BY round(-ln((n - k + 0.5) / (k + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(0, len - 2) / a)), 12), doc_id LIMIT 20"""
)
def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), "scum", 20, id="doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%z%' ORDER BY doc_id LIMIT 20")
def search_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), "z", 20, id="doc_id").select("doc_id")


@query(
    """WITH h AS (SELECT doc_id, left(text, 500) AS excerpt FROM documents WHERE contains(lower(text), 'z') ORDER BY doc_id LIMIT 200),
c AS (SELECT doc_id, sum(greatest(1, length(excerpt) // 3)) OVER (ORDER BY doc_id) AS used FROM h) SELECT doc_id, CAST(used AS BIGINT) AS used FROM c WHERE used <= 4000"""
)
def packed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(table(spark, sf_dir, "documents"), "z", 200, id="doc_id")
    return search.pack(hits, 4000, ["doc_id"]).select("doc_id", F.col("used").cast("long").alias("used"))


def _all_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user' and text is not null")
    return rows.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate set of clustering, which the operator bounds; pairs and clusters are of it."""
    return _all_prompts(spark, sf_dir).orderBy("id").limit(similarity.LIMIT)


def sql_tfidf(limit: str = "ORDER BY id LIMIT 500") -> str:
    return f"""
t AS MATERIALIZED (SELECT conv_id * 100000 + turn AS id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL {limit}),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({sql_words("text")}) AS term FROM t) GROUP BY id, term),
raw AS (SELECT id, term, tf * (ln(((SELECT count(*) FROM t) + 1) / (df + 1)) + 1) AS w FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)),
w AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


TFIDF = sql_tfidf()


@query(f"WITH {sql_tfidf('')} SELECT id, term, round(w, 9) AS w FROM w")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.tfidf(_all_prompts(spark, sf_dir)).withColumn("w", F.round("w", 9))


@query(f"WITH {TFIDF} SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS sim FROM w x JOIN w y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id HAVING round(sum(x.w * y.w), 9) >= 0.28")
def tfidf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.sparse_pairs(similarity.tfidf(_prompts(spark, sf_dir)), 0.28).withColumn("sim", F.round("sim", 6))


@query(f"WITH {sql_tfidf('')} SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS sim FROM w x JOIN w y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id HAVING round(sum(x.w * y.w), 9) >= 0.2")
def similar_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prompts, however many: the join starts at rare terms."""
    return similarity.tfidf_pairs(_all_prompts(spark, sf_dir), 0.2).withColumn("sim", F.round("sim", 6))


@query(
    """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.id < b.id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.35"""
)
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, dealt to the cells of pivots."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return similarity.dense_pairs(v, 0.35).withColumn("sim", F.round("sim", 6))


# the sequential definition: in order each item takes the most similar leader, the latest of equals, or leads
SEQUENTIAL = """
nb AS MATERIALIZED (SELECT i, list({'s': s, 'j': j}) AS near FROM p GROUP BY i),
run(i, leaders, who) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT)
  UNION ALL
  SELECT n, CASE WHEN best IS NULL THEN list_append(leaders, n) ELSE leaders END, coalesce(best, n)
  FROM (SELECT r.i + 1 AS n, r.leaders, list_reverse_sort(list_filter(nb.near, lambda x: list_contains(r.leaders, x.j)))[1].j AS best
        FROM run r LEFT JOIN nb ON nb.i = r.i + 1 WHERE r.i < (SELECT count(*) FROM e))),
cl AS MATERIALIZED (SELECT a.id AS id, b.id AS leader FROM run JOIN e a ON a.i = run.i JOIN e b ON b.i = run.who WHERE run.i > 0)"""


TEXT_CLUSTERS = f"""WITH RECURSIVE {TFIDF},
e AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY length(text) DESC, id) AS i FROM t),
p AS MATERIALIZED (SELECT greatest(a.i, b.i) AS i, least(a.i, b.i) AS j, round(sum(x.w * y.w), 9) AS s FROM w x JOIN w y ON x.term = y.term AND x.id < y.id JOIN e a ON a.id = x.id JOIN e b ON b.id = y.id
  GROUP BY ALL HAVING round(sum(x.w * y.w), 9) >= 0.28),{SEQUENTIAL}"""


@query(f"{TEXT_CLUSTERS} SELECT id, leader FROM cl")
def text_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cluster_texts(_prompts(spark, sf_dir))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS i, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 500)),
p AS MATERIALIZED (SELECT a.i AS i, b.i AS j, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON b.i < a.i WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.3),{SEQUENTIAL} SELECT id, leader FROM cl"""
)
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 vectors: the operator's bound on its candidates."""
    v = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(similarity.LIMIT).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return similarity.leaders(v.withColumn("rank", F.col("id")), similarity.dense_pairs(v, 0.3))


@query(
    f"""{TEXT_CLUSTERS},
g AS (SELECT leader, count(*) AS size, array_to_string(list(id ORDER BY id)[1:3], ',') AS members FROM cl GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT leader, term, count(*) AS df FROM (SELECT DISTINCT id, unnest({sql_words("text")}) AS term FROM t) JOIN cl USING (id) GROUP BY 1, 2),
b AS (SELECT leader, string_agg(term, ',' ORDER BY df DESC, term) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY df DESC, term) AS nth FROM f) WHERE nth <= 6 GROUP BY 1)
SELECT g.leader, size, members, left(t.text, 140) AS representative, top_terms FROM g JOIN t ON t.id = g.leader LEFT JOIN b ON b.leader = g.leader"""
)
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _prompts(spark, sf_dir)
    found = similarity.summary(texts, similarity.cluster_texts(texts))
    return found.select("leader", "size", F.array_join("members", ",").alias("members"), "representative", F.array_join("top_terms", ",").alias("top_terms"))


@query(
    """SELECT CASE WHEN regexp_matches(text, 'idiot|moron') THEN 'a' WHEN regexp_matches(text, 'trash|scum') THEN 'b' ELSE 'other' END AS theme, count(*) AS n FROM documents GROUP BY 1"""
)
def theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("a", "idiot|moron"), ("b", "trash|scum")]
    docs = table(spark, sf_dir, "documents").select("text", "doc_id")
    return habits.themes(docs, "text", rules, "other", ["doc_id"], flags="").select("theme", "n")


@query(
    """WITH c AS (SELECT split_part(p_type, ' ', 1) AS cmd_key FROM part) SELECT count(*) FILTER (regexp_matches(cmd_key, 'STANDARD')) AS n FROM c"""
)
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.count_if(F.element_at(F.split("p_type", " "), 1).rlike("STANDARD")).alias("n"))


@query(
    """SELECT coalesce(a.name, b.name) AS name, coalesce(a.n, 0) AS installs, coalesce(b.n, 0) AS mentions FROM (SELECT p_brand AS name, count(*) AS n FROM part WHERE p_size < 3 GROUP BY 1) a
FULL JOIN (SELECT p_brand AS name, count(*) AS n FROM part WHERE p_size > 48 GROUP BY 1) b ON a.name = b.name"""
)
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counts(condition: str) -> DataFrame:
        return table(spark, sf_dir, "part").filter(condition).groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))

    return export.merged_counts(counts("p_size < 3"), counts("p_size > 48"))


@query(
    """WITH l AS (SELECT doc_id, n_chars AS size, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS now FROM documents)
SELECT CASE WHEN doc_id % 7 = 0 THEN 'check' WHEN size = now THEN 'skipped' ELSE 'check' END AS status, count(*) AS n FROM l GROUP BY 1"""
)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing against a manifest in which every fifth file has grown and every seventh is missing."""
    epoch = F.lit(dt.datetime(2024, 1, 1))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "doc_id", epoch.alias("file_mtime"), F.col("n_chars").alias("file_size"))
    manifest = docs.filter("doc_id % 7 <> 0").select("file_path", "file_mtime", "file_size", F.lit("h").alias("content_hash"), F.lit("s").alias("session_id"))
    listing = docs.withColumn("file_size", F.when(F.col("doc_id") % 5 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")))
    return store.diff(listing.drop("doc_id"), manifest).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT user_id AS id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = store.latest(e, "user_id", "ts", "event_id").select(F.col("user_id").alias("id"), "event_type")
    return last.join(e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")), "id")


@query(
    """SELECT c_mktsegment, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o_orderstatus = 'F' GROUP BY 1"""
)
def child_parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of children with filtered parents that digests use."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return digest.top_counts(o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment")


@query(
    """WITH s AS (SELECT term, count(*) AS weight FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,4}')) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 10),
k4 AS (SELECT * FROM s WHERE length(term) >= 4),
p3 AS (SELECT part, max(weight) AS o FROM (SELECT unnest([substr(term, 1, 3), substr(term, 2, 3)]) AS part, weight FROM k4) GROUP BY 1),
k3 AS (SELECT * FROM k4 UNION ALL SELECT s.* FROM s LEFT JOIN p3 ON part = term WHERE length(term) = 3 AND (o IS NULL OR weight > o * 1.5)),
p2 AS (SELECT part, max(weight) AS o FROM (SELECT unnest(list_transform(range(1, length(term)), lambda i: substr(term, i, 2))) AS part, weight FROM k3) GROUP BY 1)
SELECT * FROM k3 UNION ALL SELECT s.* FROM s LEFT JOIN p2 ON part = term WHERE length(term) = 2 AND (o IS NULL OR weight > o * 1.5)"""
)
def gram_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match reduction of the most common letter grams of documents."""
    docs = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,4}"), F.lit(0))).alias("term"))
    return export.longest_only(docs.groupBy("term").agg(F.count("*").alias("weight")))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 3) AS INTEGER) AS cost, left(text, 40) AS head, sha1(text) AS digest FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncation by code points, estimated tokens, and the digest used for change detection."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_cost(t).alias("cost"), F.substring(t, 1, 40).alias("head"), F.sha1(t).alias("digest"))


@query(r"SELECT lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\.[^.]*)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1")
def url_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(tx.file_ext(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query("SELECT '/' || p[1] || '/' || p[2] AS root, count(*) AS n FROM (SELECT list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages) GROUP BY 1")
def url_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.top_counts(table(spark, sf_dir, "pages").select(tx.project_root(F.col("url"), "/home/nobody").alias("root")), "root")


@query("SELECT left(array_to_string(string_split(p_name, ' ')[1:2], ' '), 60) AS cmd_key, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, cmd_key LIMIT 25")
def top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(tx.command_key(F.concat(F.lit("cd /x && "), "p_name"), "/home/nobody").alias("cmd_key"))
    return digest.top_counts(keys, "cmd_key", 25)


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as ISO text are parsed again; text that isn't one is skipped."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, sf_dir, "events").select(F.explode(F.array(iso, F.lit("2024"), F.lit("x"))).alias("t"))
    return rows.select(F.hour(tx.parse_ts(F.col("t"))).alias("hour")).filter("hour is not null").groupBy("hour").agg(F.count("*").alias("n"))


COMMANDS = {"purchase": "npm test", "click": "git commit", "view": "npm run", "error": "mypy src"}
_CASES = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMANDS.items()) + " ELSE 'ls' END"


@query(
    f"""WITH c AS (SELECT {_CASES} AS cmd_key, CASE WHEN event_id % 3 = 0 THEN 'Edit' ELSE 'Bash' END AS tool FROM events)
SELECT count(*) FILTER (cmd_key = 'npm test') AS test, count(*) FILTER (starts_with(cmd_key, 'git')) AS git, count(*) FILTER (starts_with(cmd_key, 'mypy')) AS typecheck,
  count(*) FILTER (cmd_key = 'npm run') AS build, count(*) FILTER (cmd_key = 'git commit') AS commits, count(*) FILTER (tool = 'Edit') AS edits,
  count(*) FILTER (cmd_key = 'npm test') / count(*) FILTER (tool = 'Edit') AS test_to_edit_ratio FROM c"""
)
def verification_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    calls = e.select(F.expr(_CASES).alias("cmd_key"), F.when(F.col("event_id") % 3 == 0, "Edit").otherwise("Bash").alias("tool"))
    return habits.verification(calls)


@query(
    """WITH t AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, 'idiot|moron') THEN 'a' WHEN regexp_matches(text, 'trash|scum') THEN 'b' ELSE 'other' END AS theme FROM documents),
f AS (SELECT theme, left(text, 140) AS quote, min(doc_id) AS pos FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY pos, quote) AS nth FROM f)
SELECT theme, string_agg(quote, '|' ORDER BY nth) AS quotes FROM r WHERE nth <= 3 GROUP BY theme"""
)
def theme_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("a", "idiot|moron"), ("b", "trash|scum")]
    docs = table(spark, sf_dir, "documents").select("text", "doc_id")
    return habits.themes(docs, "text", rules, "other", ["doc_id"], flags="").select("theme", F.array_join("quotes", "|").alias("quotes"))


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of streaming.ingest.counts_by_window."""
    day = F.window("ts", "1 day")["start"]
    return table(spark, sf_dir, "events").groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT event_type AS quote, min((ts, event_id)) AS pos FROM events GROUP BY 1)
SELECT quote, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS nth FROM f"""
)
def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("quote"), "ts", "event_id")
    first = digest.first_of_each(e, "quote", "ts", "event_id")
    return first.select("quote", F.row_number().over(Window.orderBy("ts", "event_id")).alias("nth"))


def sql_first(x: str, rules: list[tuple[str, str]], other: str, flags: str = "(?i)") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {lit(flags + p)}) THEN {lit(name)}" for name, p in rules) + f" ELSE {lit(other)} END"


def sql_pick(values: list[str], index: str) -> str:
    return f"([{', '.join(lit(v) for v in values)}])[{index} % {len(values)} + 1]"


def pick(values: list[str], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({index} % {len(values)} + 1 as int)"))


_EVENT_LINES = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 5 <> 0 AS dated,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS model, CASE WHEN event_id % 4 = 0 THEN props ELSE '' END AS originator, CAST(floor(value) AS BIGINT) AS tokens,
  event_type IN ('purchase', 'view') AS said, event_type = 'error' AND event_id % 50 = 0 AS delegated"""


@query(
    f"""WITH r AS ({_EVENT_LINES}, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM events)
SELECT 'ev:' || user_id AS id, arg_max(model, i) FILTER (model <> '') AS model, arg_max(originator, i) FILTER (originator <> '') AS originator, arg_min(t, i) FILTER (dated) AS started_at,
  arg_max(t, i) FILTER (dated) AS ended_at, CAST(CASE WHEN user_id % 2 = 0 THEN greatest(0, max(tokens)) ELSE sum(tokens) END AS BIGINT) AS out_tokens, count(*) FILTER (said) AS n_asst
FROM r GROUP BY user_id HAVING count(*) FILTER (said) > 0"""
)
def sessions_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from lines in order: last non-empty values, first and last valid times, sums or cumulative counters."""
    rows = spark.sql(f"{_EVENT_LINES}, CASE WHEN event_id % 5 <> 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") ELSE 'x' END AS t FROM {{events}}", events=table(spark, sf_dir, "events"))
    none = F.lit(None).cast("string")
    records = rows.select(
        F.col("user_id").cast("string").alias("file_path"), F.col("i").alias("line_no"), F.col("user_id").cast("string").alias("stem"), F.when(F.col("said"), "assistant").otherwise("other").alias("kind"),
        F.col("t").alias("ts"), none.alias("text"), none.alias("native_id"), none.alias("cwd"), "model", "originator", "tokens", (F.col("user_id") % 2 == 0).alias("cumulative"),
        F.lit(None).cast("array<struct<tool: string, command: string, file: string, workdir: string>>").alias("calls"), "delegated",
    )
    return sessions.build(records, "events", "ev").session.select("id", "model", "originator", "started_at", "ended_at", "out_tokens", "n_asst")


_TOOLS = "p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b"


@query(
    f"""WITH p AS (SELECT {_TOOLS} FROM part), k AS (SELECT unnest(list_distinct(CASE p_partkey % 3 WHEN 0 THEN [a, '@s/' || b] WHEN 1 THEN [a, b] ELSE [a] END)) AS package FROM p)
SELECT package, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, package LIMIT 25"""
)
def packages_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most installed packages of commands in three managers' spellings, versions and flags left out."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "split_part(p_name, ' ', 1) AS a", "split_part(p_name, ' ', 2) AS b")
    which = F.col("p_partkey") % 3
    command = F.when(which == 0, F.format_string("cd x && npm i %s@1.2 --save @s/%s@3 | tee log", "a", "b")).when(which == 1, F.format_string("python3 -m pip install -U %s==2.0 '%s>=1'", "a", "b")).otherwise(F.format_string("uv add %s[extra] $HOME ./local", "a"))
    return habits.exploded_counts(p, tx.install_pkgs(command), "package", 25)


@query(
    """WITH k AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pip3' WHEN 2 THEN 'uv' END AS manager FROM part) SELECT manager, count(*) AS n FROM k WHERE manager IS NOT NULL GROUP BY 1"""
)
def managers_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(tx.manager(pick(["npm i", " PIP3 install", "uv add", "ls -l"], "p_partkey")).alias("manager"))
    return digest.top_counts(keys.filter("manager is not null"), "manager")


@query("SELECT target, count(*) AS n FROM (SELECT unnest(['/w/' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || ' x']) AS target FROM part) GROUP BY 1")
def directories_entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("split_part(p_name, ' ', 1) AS a", "split_part(p_name, ' ', 2) AS b")
    return digest.top_counts(p.select(F.explode(tx.cd_targets(F.format_string("cd /w/%s && make; cd '%s x' || true", "a", "b"))).alias("target")), "target")


_OPENERS = ["no, that", "actually, do", "Revert it", "thanks and", "太丑 了", "know, that", "undone"]


@query(
    f"""WITH m AS (SELECT {sql_pick(_OPENERS, "(conv_id + turn)")} || ' ' || text AS t, turn % 2 = 0 AS later FROM conversations WHERE text IS NOT NULL)
SELECT count(*) FILTER (later AND length(t) < 600 AND regexp_matches(left(t, 120), {lit("(?i)" + lx.CORRECTION)})) AS corrections, count(*) AS rows FROM m"""
)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by the real pattern in turns whose openings vary."""
    m = table(spark, sf_dir, "conversations").filter("text is not null").select(F.concat(pick(_OPENERS, "(conv_id + turn)"), F.lit(" "), "text").alias("t"), (F.col("turn") % 2 == 0).alias("later"))
    return m.agg(F.count_if(tx.is_friction(F.col("t"), F.col("later"))).alias("corrections"), F.count("*").alias("rows"))


_COMPLAINTS = ["这个配色 难看", "说人话", "别用 mock 数据", "没按 要求", "too long 太长", "please revert", "else", "别用那些词"]


@query(
    f"""WITH t AS (SELECT doc_id, {sql_pick(_COMPLAINTS, "doc_id")} || ' ' || (doc_id % 3) AS x FROM documents),
m AS (SELECT doc_id, x, {sql_first("x", lx.PROFILE_THEMES, lx.PROFILE_OTHER)} AS theme FROM t),
f AS (SELECT theme, left(x, 140) AS quote, min(doc_id) AS pos FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY pos) AS nth FROM f)
SELECT theme, n, quotes FROM (SELECT theme, count(*) AS n FROM m GROUP BY 1) JOIN (SELECT theme, string_agg(quote, '|' ORDER BY nth) AS quotes FROM r WHERE nth <= 3 GROUP BY 1) USING (theme)"""
)
def profile_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and first quotes of the real themes."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(pick(_COMPLAINTS, "doc_id"), F.lit(" "), (F.col("doc_id") % 3).cast("string")).alias("x"))
    return habits.themes(t, "x", lx.PROFILE_THEMES, lx.PROFILE_OTHER, ["doc_id"]).select("theme", "n", F.array_join("quotes", "|").alias("quotes"))


_FOLDED = "CASE x " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in lx.LIBRARY_ALIASES.items()) + " ELSE x END"


@query(
    f"""WITH d AS (SELECT doc_id, unnest([{sql_pick(lx.LIBRARIES, "doc_id")}, {sql_pick(lx.LIBRARIES, "(doc_id * 7)")}]) AS x FROM documents)
SELECT library, count(*) AS n FROM (SELECT DISTINCT doc_id, {_FOLDED} AS library FROM d) GROUP BY 1 ORDER BY n DESC, library LIMIT 25"""
)
def libraries_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most named libraries, by the real list and its other spellings."""
    t = table(spark, sf_dir, "documents").select(F.format_string("use (%s), then %s! not reactor or x-d3", pick(lx.LIBRARIES, "doc_id"), F.upper(pick(lx.LIBRARIES, "(doc_id * 7)"))).alias("t"))
    return habits.exploded_counts(t, tx.libraries(F.col("t")), "library", 25)


_CJK = ("etaoinsh", "这个布局配色很好")


@query(
    f"""WITH p AS (SELECT 1 + conv_id % 3 AS n, translate(text, '{_CJK[0]}', '{_CJK[1]}') AS prompt FROM conversations WHERE role = 'user' AND text IS NOT NULL),
r AS (SELECT n, unnest(regexp_extract_all(prompt, '[一-鿿]{{2,}}')) AS run FROM p),
g AS (SELECT n, unnest(list_distinct(list_concat(list_transform(range(1, length(run) - 2), lambda i: substr(run, i, 4)), list_concat(list_transform(range(1, length(run) - 1), lambda i: substr(run, i, 3)), list_transform(range(1, length(run)), lambda i: substr(run, i, 2)))))) AS term FROM r)
SELECT term, CAST(sum(n) AS BIGINT) AS weight FROM g WHERE term NOT IN ({", ".join(lit(w) for w in lx.CJK_COMMON)}) GROUP BY 1"""
)
def cjk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams of CJK runs in user turns whose common letters are replaced by characters."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user' and text is not null")
    return export.cjk_grams(rows.select((1 + F.col("conv_id") % 3).alias("n"), F.translate("text", *_CJK).alias("prompt")))


_EXTENSIONS = [".ts", ".TSX", ".py", ".md", ".rs", ".html", ".sql", ".mjs"]
_LANGUAGES = ", ".join(f"({lit(e)}, {lit(x)})" for e, x in lx.LANGUAGES)


@query(
    f"""WITH e AS (SELECT lower({sql_pick(_EXTENSIONS, "(p_partkey * p_size)")}) AS ext, count(*) AS n FROM part GROUP BY 1),
l AS (SELECT language, max((n, ext)) AS best FROM e JOIN (VALUES {_LANGUAGES}) AS v(ext, language) USING (ext) GROUP BY 1)
SELECT language FROM l ORDER BY best[1] DESC, language LIMIT 5"""
)
def languages_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = digest.top_counts(table(spark, sf_dir, "part").select(pick(_EXTENSIONS, "(p_partkey * p_size)").alias("ext")), "ext")
    return export.main_languages(ext)


_KNOWN = [name for own in lx.STACK.values() for name, _ in own]
_STACK = ", ".join(f"({lit(name)}, {lit(g)}, {i}, {lit(d)})" for i, (g, own) in enumerate(lx.STACK.items()) for name, d in own)


@query(
    f"""WITH a AS (SELECT {sql_pick(_KNOWN, "(p_partkey * p_partkey)")} AS name, count(*) AS installs FROM part WHERE p_size < 5 GROUP BY 1),
b AS (SELECT {sql_pick(_KNOWN, "(p_partkey * 3)")} AS name, count(*) AS mentions FROM part WHERE p_size > 45 GROUP BY 1),
m AS (SELECT coalesce(a.name, b.name) AS name, coalesce(installs, 0) AS installs, coalesce(mentions, 0) AS mentions FROM a FULL JOIN b ON a.name = b.name),
s AS (SELECT name, grp, o, display, installs * 3 + mentions AS score FROM m JOIN (VALUES {_STACK}) AS v(name, grp, o, display) USING (name) WHERE installs >= 1 OR mentions >= 2),
f AS (SELECT grp, o, display, max(score) AS score, arg_min(name, (-score, name)) AS name FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, name) AS nth FROM f)
SELECT grp, string_agg(display, ' · ' ORDER BY nth) AS displays FROM r WHERE nth <= 8 GROUP BY grp"""
)
def technology_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known technologies by group, installs counting three times as much as mentions."""
    part = table(spark, sf_dir, "part")
    installs = digest.top_counts(part.filter("p_size < 5").select(pick(_KNOWN, "(p_partkey * p_partkey)").alias("name")), "name")
    mentions = digest.top_counts(part.filter("p_size > 45").select(pick(_KNOWN, "(p_partkey * 3)").alias("name")), "name")
    return export.stack(installs, mentions).select("grp", F.array_join("displays", " · ").alias("displays"))


@query(
    """WITH s AS (SELECT p_brand AS name, count(*) / sum(count(*)) OVER () AS share FROM part GROUP BY 1)
SELECT '经常在「' || name || '」项目上工作(AI 会话占比约 ' || CAST(round_even(share * 100, 0) AS INTEGER) || '%)' AS topic FROM s WHERE share >= 0.03 ORDER BY share DESC, name LIMIT 4"""
)
def project_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = digest.with_share(digest.top_counts(table(spark, sf_dir, "part"), "p_brand"))
    return export.topics(shares.select(F.concat(F.lit("/w/"), "p_brand", F.lit("/")).alias("cwd"), "share"))


_KINDS = ["real", "meta", "artifact"]


@query(
    f"""WITH m AS (SELECT *, greatest(0, length(text) - 2) AS d, {sql_pick(_KINDS, "conv_id")} AS kind,
  (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS f FROM conversations WHERE role = 'user' AND text IS NOT NULL),
g AS (SELECT count(*) AS rows, count(*) FILTER (f > 0) AS hits, avg(d) AS avg_d FROM m),
i AS (SELECT CASE WHEN ln((rows - hits + 0.5) / (hits + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows - hits + 0.5) / (hits + 0.5)) END AS idf, avg_d FROM g)
SELECT 's' || conv_id AS session, turn AS seq, kind, round(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avg_d)), 9) AS rank FROM m, i WHERE f > 0 AND kind IN ('real', 'meta')"""
)
def hits_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a phrase in sessions of two kinds, ranked by the statistics of all messages; artifacts never count."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("session_id", F.concat(F.lit("s"), "conv_id"))
    session = c.select(F.col("session_id").alias("id"), pick(_KINDS, "conv_id").alias("kind"), F.lit("a").alias("source"), F.lit("p").alias("project")).distinct()
    message = c.select("session_id", F.col("turn").alias("seq"), F.lit("").alias("ts"), "text")
    found, _ = search.session_hits(message, session, " tion ")
    return found.join(session.select(F.col("id").alias("session"), "kind"), "session").select("session", "seq", "kind", F.round("rank", 9).alias("rank"))


@query(
    """WITH f AS (SELECT event_id AS file, 'u' || user_id AS id, CASE WHEN event_id % 3 = 0 THEN 'u' || (user_id + 1) END AS old FROM events WHERE event_type IN ('purchase', 'error')),
w AS (SELECT id, max(file) AS file FROM f GROUP BY 1), c AS (SELECT old AS id, max(file) AS cut FROM f WHERE old IS NOT NULL GROUP BY 1)
SELECT w.id, file_path FROM (SELECT id, format('{:09d}', file) AS file_path, file FROM w) w LEFT JOIN c USING (id) WHERE cut IS NULL OR cut <= file"""
)
def sessions_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that an ingest of many files leaves: of one id the last file's, unless a later file had given it before."""
    f = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'error')")
    rows = f.select(F.concat(F.lit("u"), "user_id").alias("id"), F.format_string("%09d", "event_id").alias("file_path"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id") + 1)).alias("old_id"))
    return store.surviving(rows.select("id", "file_path"), rows.select("file_path", "old_id"))


def logged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as log lines of typed blocks: even turns have a string, odd ones a list of blocks."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    block = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text")))
    listed = F.concat(block, F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))))
    usage, stamp = F.struct(F.length("text").alias("output_tokens")), F.format_string("2024-01-01T00:00:%02dZ", F.col("turn"))

    def line(content: Column) -> Column:
        message = F.struct(content.alias("content"), usage.alias("usage"), F.format_string("m-%d", F.col("turn") % 3).alias("model"))
        return F.to_json(F.struct(F.col("role").alias("type"), stamp.alias("timestamp"), F.format_string("/srv/p%d/x", F.col("conv_id") % 7).alias("cwd"), message.alias("message")))

    rec = F.try_parse_json(F.when(F.col("turn") % 2 == 0, line(F.col("text"))).otherwise(line(listed)))
    return c.select(F.format_string("file:/logs/%d.jsonl", "conv_id").alias("file_path"), F.col("turn").alias("line_no"), rec.alias("rec"))


LOGGED = """logged AS (SELECT r.conv_id, any_value(s.kind) AS kind, any_value(s.n_user) AS n_user, any_value(s.n_asst) AS n_asst, CAST({tokens} AS BIGINT) AS out_tokens, {model} AS model,
  printf('2024-01-01T00:00:%02dZ', min(r.turn)) AS started_at, printf('2024-01-01T00:00:%02dZ', max(r.turn)) AS ended_at, '/srv/p' || CAST(r.conv_id % 7 AS VARCHAR) AS project
  FROM records r JOIN session s ON s.id = 'conv:' || r.conv_id GROUP BY r.conv_id)"""


@query(
    f"WITH {RECORDS}, "
    + LOGGED.format(tokens="coalesce(sum(length(r.text)) FILTER (r.kind = 'assistant'), 0)", model="'m-' || CAST(max(r.turn) FILTER (r.kind = 'assistant') % 3 AS VARCHAR)")
    + " SELECT 'cc:' || conv_id AS id, kind, n_user, n_asst, out_tokens, model, started_at, ended_at, project FROM logged"
)
def sessions_of_block_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions through the JSON lines of the first source: texts of strings and blocks, summed tokens, last values, first and last times."""
    t = sessions.build(blocks.normalise(logged_blocks(spark, sf_dir)), "chat", "cc", home="/home/nobody")
    return t.session.select("id", "kind", "n_user", "n_asst", "out_tokens", "model", "started_at", "ended_at", "project")


def logged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as log lines of events: context, messages, and a running count of tokens."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    stamp = F.format_string("2024-01-01T00:00:%02dZ", F.col("turn"))

    def line(kind: str, *payload: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), stamp.alias("timestamp"), F.struct(*payload).alias("payload")))

    place = F.format_string("/srv/p%d/x", F.col("conv_id") % 7).alias("cwd")
    used = F.struct(F.struct((F.col("turn") * 10).alias("output_tokens"), F.lit(1).alias("reasoning_output_tokens")).alias("total_token_usage")).alias("info")
    arguments = F.to_json(F.struct(F.array(F.lit("git"), F.lit("log"), F.col("role")).alias("command"), place.alias("workdir"))).alias("arguments")
    lines = F.array(
        line("session_meta", F.format_string("n%d", "conv_id").alias("id"), place),
        line("turn_context", place, F.format_string("m-%d", F.col("turn") % 3).alias("model")),
        F.when(F.col("role") == "user", line("event_msg", F.lit("user_message").alias("type"), F.col("text").alias("message"))).when(F.col("role") == "assistant", line("event_msg", F.lit("agent_message").alias("type"))),
        line("event_msg", F.lit("token_count").alias("type"), used),
        F.when(F.col("role") == "assistant", line("response_item", F.lit("function_call").alias("type"), F.lit("shell").alias("name"), arguments)),
    )
    told = c.select("conv_id", "turn", F.posexplode(lines).alias("pos", "line")).filter("line is not null")
    return told.select(F.format_string("file:/logs/%d.jsonl", "conv_id").alias("file_path"), (F.col("turn") * 10 + F.col("pos")).alias("line_no"), F.try_parse_json("line").alias("rec"))


@query(
    f"WITH {RECORDS}, "
    + LOGGED.format(tokens="max(r.turn) * 10 + 1", model="'m-' || CAST(max(r.turn) % 3 AS VARCHAR)")
    + " SELECT 'cx:n' || conv_id AS id, kind, n_user, n_asst, out_tokens, model, started_at, ended_at, project FROM logged"
)
def sessions_of_event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the second source: its own ids, contexts and the last of a running count of tokens."""
    t = sessions.build(events.normalise(logged_events(spark, sf_dir)), "chat", "cx", home="/home/nobody")
    return t.session.select("id", "kind", "n_user", "n_asst", "out_tokens", "model", "started_at", "ended_at", "project")


@query(f"WITH {RECORDS} SELECT 'cx:n' || conv_id AS session_id, seq AS after_seq, 'codex:shell' AS tool, 'git log' AS cmd_key, '/srv/p' || CAST(conv_id % 7 AS VARCHAR) || '/x' AS workdir FROM turns WHERE kind = 'assistant'")
def tool_calls_of_event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls whose arguments are JSON inside JSON, after the assistant's turn before them."""
    t = sessions.build(events.normalise(logged_events(spark, sf_dir)), "chat", "cx", home="/home/nobody")
    return t.tool_call.select("session_id", "after_seq", "tool", "cmd_key", "workdir")


@query(
    r"""WITH c AS (SELECT split_part(url, '/', 3) AS host, page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 2) AS lang, regexp_extract(url, '^https?://[^/]*/[^/]*/([^/?#]*)', 1) AS page FROM pages),
h AS (SELECT host, '/' || lang || '/' || page AS hint, page_id FROM c),
v AS (SELECT host, hint, count(*) AS n, min(page_id) AS first FROM h GROUP BY 1, 2)
SELECT host, arg_min(hint, (-n, first)) AS hint FROM v GROUP BY host"""
)
def most_hinted_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project that most tool calls of a session hint at: here the pages of a host as calls in their directories."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "")
    call = F.struct(F.lit("Bash").alias("tool"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("string").alias("file"), F.concat(path, F.lit("/deeper")).alias("workdir"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "pages").select(
        F.split("url", "/")[2].alias("file_path"), F.col("page_id").alias("line_no"), F.lit("s").alias("stem"), F.lit("assistant").alias("kind"), none.alias("ts"), none.alias("native_id"), none.alias("cwd"), none.alias("model"),
        none.alias("originator"), F.lit(0).alias("tokens"), F.lit(False).alias("cumulative"), F.array(call).alias("calls"), F.lit(False).alias("delegated"), none.alias("prompt"), F.lit(False).alias("is_task"),
    )
    return sessions.rolled(rows, "/home/nobody").select(F.col("file_path").alias("host"), "hint")


OPENINGS = "(SELECT left(text, CAST(20 + doc_id % 30 AS INTEGER)) AS text FROM documents)"


@query(
    f"""WITH style AS ({STYLE.replace("FROM documents", "FROM " + OPENINGS)}), mix AS (SELECT avg(CAST(length(text) < 40 AS INTEGER)) AS terse_share FROM {OPENINGS})
SELECT fact FROM (SELECT unnest([{", ".join(f"CASE WHEN {rule} THEN {lit(fact)} END" for rule, fact in lx.STYLE_RULES)}]) AS fact FROM style, mix) WHERE fact IS NOT NULL"""
)
def style_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the openings of the documents, as prompts, say about their writer."""
    docs = table(spark, sf_dir, "documents").select(F.substring(F.col("text"), F.lit(1), (20 + F.col("doc_id") % 30).cast("int")).alias("text"))
    terse = docs.filter("text is not null").agg(F.coalesce(F.avg((F.length("text") < 40).cast("double")), F.lit(0.0)).alias("terse_share"))
    return export.style_facts(habits.style(docs).crossJoin(F.broadcast(terse))).select("fact")


@query("SELECT p_brand AS name FROM part GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM part) ORDER BY count(*) DESC, name LIMIT 5")
def main_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = digest.with_share(digest.top_counts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("project")), "project"))
    return export.main_projects(shares.select(F.col("project").alias("cwd"), "share")).select("name")


@query(
    f"""WITH names AS ({ORACLES["page_names"]}), nouns AS ({ORACLES["proper_nouns"]}), terms AS (SELECT * FROM names UNION ALL SELECT * FROM nouns WHERE weight >= {export.ENGLISH_LEAST})
SELECT term, CAST(sum(weight) AS BIGINT) AS weight FROM terms GROUP BY 1 ORDER BY weight DESC, term LIMIT {export.MOST_TERMS}"""
)
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, proper nouns and CJK grams together; the documents have no CJK text, whose grams gram_dedup and cjk_terms show."""
    projects = table(spark, sf_dir, "pages").select(F.col("url").alias("cwd"), F.lit(1).alias("sessions"))
    return export.terms(projects, table(spark, sf_dir, "documents").select(F.col("text").alias("prompt"), F.lit(1).alias("n"))).select("term", "weight")


@query(
    """WITH s AS (SELECT user_id % 3 AS k, count(*) AS n, coalesce(sum(event_id), 0) AS tokens FROM events GROUP BY user_id)
SELECT CAST(k AS VARCHAR) AS source, CAST(sum(tokens) AS BIGINT) AS output_tokens, CAST(sum(n) AS BIGINT) AS messages, count(*) AS sessions FROM s GROUP BY k"""
)
def tokens_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions of three sources: tokens, messages and sessions of each."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("out_tokens")).select((F.col("user_id") % 3).cast("string").alias("source"), "n", "out_tokens")
    return digest.totals_by_source(s, {"output_tokens": "out_tokens", "messages": "n"})


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged partials of four parts of the conversations' sessions, whose tables are written first as a store's are."""
    t, scratch = conversation_tables(spark, sf_dir), Scratch(spark)
    written = sessions.Tables(scratch.write(t.session), scratch.write(t.message), scratch.write(t.tool_call))
    return partials.merged(partials.partial(written, F.pmod(F.xxhash64("session_id"), F.lit(4)).cast("int")))


@query(ORACLES["task_prompts"])
def tasks_of_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and first rows that merged over parts."""
    return _partials(spark, sf_dir).filter("metric = 'task'").select(F.col("key").alias("sig"), "n", F.col("text").alias("prompt"))


@query(
    f"""WITH {RECORDS}, m AS (SELECT left({sql_redacted("prompt")}, 4000) AS text FROM turns JOIN session s ON s.id = 'conv:' || conv_id WHERE prompt IS NOT NULL AND s.kind = 'real')
SELECT count(*) AS n_prompts, CAST(coalesce(median(length(text)), 0) AS DOUBLE) AS median_chars, round(avg(CAST(regexp_matches(text, {lit(lx.CJK)}) AS INTEGER)), 9) AS cjk_share,
  round(avg(CAST(regexp_matches(text, {lit("(?i)" + lx.ACCEPTANCE)}) AS INTEGER)), 9) AS acceptance_rate, round(avg(CAST(regexp_matches(text, {lit("(?i)" + lx.DISCUSS)}) AS INTEGER)), 9) AS discuss_first_rate FROM m"""
)
def style_of_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of all prompts, its exact median from the merged histogram of lengths."""
    found = partials.style(_partials(spark, sf_dir))
    return found.select("n_prompts", "median_chars", *[F.round(c, 9).alias(c) for c in ("cjk_share", "acceptance_rate", "discuss_first_rate")])
