"""Sessions, messages and tool calls from ordered records.

Records have one row for each log line: file_path, line_no, stem, kind (user,
assistant or other), ts, text, native_id, cwd, model, originator, tokens,
cumulative, calls (array of tool, command, file, workdir), delegated.  What
the order decides is expressed with windows over a file's lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators import scans

TEXT_LIMIT = 4000


@dataclass(frozen=True)
class Tables:
    session: DataFrame
    message: DataFrame
    tool_call: DataFrame


def accepted(text: Column) -> Column:
    """Whether a user record is a prompt of the user's own."""
    plain = tx.unwrap(text)
    return ~tx.is_injected(plain) & tx.is_real_prompt(plain)


#: Lines of a segment, for files whose lines shouldn't pass through one window each.
SEGMENT = 100_000


def sequenced(records: DataFrame, segment: int | None = None) -> DataFrame:
    """Adds prompt (accepted text), is_task (of a prompt), seq (accepted turns so far), turn_seq (that of the last assistant turn) and after_assistant.

    A rejected user record has no seq, but still ends the turn of the
    assistant; records of other kinds change nothing.  With ``segment``, long
    files are cut into segments of so many lines, which then need no window
    over a whole file, but a second pass over records.
    """
    user, assistant = F.col("kind") == "user", F.col("kind") == "assistant"
    marked = records.withColumn("prompt", F.when(user & accepted(F.col("text")), tx.unwrap(F.col("text"))))
    counts = F.when(F.col("prompt").isNotNull() | assistant, 1).otherwise(0)
    turn = F.when(user | assistant, assistant)
    # the windows below keep these expressions from being copied into each of their uses
    marked = marked.withColumn("is_task", tx.is_task_prompt(F.col("prompt")))
    if segment:
        rows = scans.carried(marked, ["file_path"], "line_no", segment, {"seq": counts}, {"turn_seq": (assistant, "seq")}, {"after_assistant": turn})
    else:
        by_file = Window.partitionBy("file_path").orderBy("line_no")
        so_far, before = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_file.rowsBetween(Window.unboundedPreceding, -1)
        rows = marked.withColumn("seq", F.sum(counts).over(so_far))
        rows = rows.withColumn("turn_seq", F.last(F.when(assistant, F.col("seq")), ignorenulls=True).over(so_far)).withColumn("after_assistant", F.last(turn, ignorenulls=True).over(before))
    return rows.withColumns({"turn_seq": F.coalesce("turn_seq", F.lit(0)), "after_assistant": F.coalesce("after_assistant", F.lit(False))})


def session_kind(n_user: Column, has_task: Column, delegated: Column) -> Column:
    return F.when(delegated | (n_user == 0), "meta").when(~has_task, "artifact").otherwise("real")


def build(records: DataFrame, source: str, prefix: str, home: str | None = None, segment: int | None = None) -> Tables:
    """The three tables of one source, each row with its file_path; sessions without any turn are dropped."""
    return tables(sequenced(records, segment), source, prefix, home)


def hints(call: Column, home: str | None = None) -> Column:
    """Project directories that a tool call hints at, in order."""
    places = F.concat(F.coalesce(tx.cd_targets(call["command"]), F.array().cast("array<string>")), F.array(call["file"], call["workdir"]))
    return F.filter(F.transform(places, lambda p: tx.project_root(p, home)), lambda h: h.isNotNull())


def rolled(rows: DataFrame, home: str | None = None) -> DataFrame:
    """One row for each file of sequenced rows: first and last values, counts, and the project that most tool calls hint at."""

    def last_of(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c) != "", F.col("line_no"))).alias(c)

    dated = F.when(tx.parse_ts(F.col("ts")).isNotNull(), F.col("line_no"))
    total = F.when(F.bool_or("cumulative"), F.greatest(F.lit(0), F.coalesce(F.max("tokens"), F.lit(0)))).otherwise(F.coalesce(F.sum("tokens"), F.lit(0)))
    summed = rows.groupBy("file_path", "stem").agg(
        last_of("native_id"),
        last_of("cwd"),
        last_of("model"),
        last_of("originator"),
        F.min_by("ts", dated).alias("started_at"),
        F.max_by("ts", dated).alias("ended_at"),
        F.count_if(F.col("prompt").isNotNull()).alias("n_user"),
        F.count_if(F.col("kind") == "assistant").alias("n_asst"),
        total.alias("out_tokens"),
        F.coalesce(F.bool_or("is_task"), F.lit(False)).alias("has_task"),
        F.bool_or("delegated").alias("delegated"),
    )
    calls = rows.filter("size(calls) > 0").select("file_path", "line_no", F.posexplode("calls").alias("pos", "call"))
    roots = calls.select("file_path", F.struct("line_no", "pos").alias("at"), F.explode(hints(F.col("call"), home)).alias("hint"))
    votes = roots.groupBy("file_path", "hint").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    top = votes.groupBy("file_path").agg(F.min_by("hint", F.struct((-F.col("n")).alias("n"), "at")).alias("hint"))
    return summed.join(top, "file_path", "left")


def tables(rows: DataFrame, source: str, prefix: str, home: str | None = None, kept: Callable[[DataFrame], DataFrame] = lambda df: df, files: DataFrame | None = None) -> Tables:
    """The tables of sequenced rows; kept is applied to the sessions, which both other tables are joined with.

    ``files`` has the rolled values of each file, where they don't come from rows alone.
    """
    found = (rolled(rows, home) if files is None else files).filter("n_user > 0 or n_asst > 0")
    session = kept(found.select(
        F.concat(F.lit(f"{prefix}:"), F.coalesce("native_id", "stem")).alias("id"),
        F.lit(source).alias("source"),
        "file_path",
        F.coalesce(tx.project_root(F.col("cwd"), home), "hint", F.lit("<none>")).alias("project"),
        F.coalesce(tx.redact(F.col("cwd"), home), F.lit("")).alias("cwd_raw"),
        "model",
        "originator",
        "started_at",
        "ended_at",
        "n_user",
        "n_asst",
        "out_tokens",
        session_kind(F.col("n_user"), F.col("has_task"), F.col("delegated")).alias("kind"),
    ))
    ids = session.select("file_path", F.col("id").alias("session_id"))
    said = F.substring(tx.redact(F.col("prompt"), home), 1, TEXT_LIMIT)
    is_task = F.col("is_task")
    message = (
        rows.filter("prompt is not null")
        .join(ids, "file_path")
        .select(
            "session_id",
            "seq",
            "ts",
            F.lit("user").alias("role"),
            said.alias("text"),
            is_task.alias("is_task"),
            tx.is_friction(F.col("prompt"), F.col("after_assistant")).alias("is_friction"),
            F.when(is_task, tx.signature(said)).alias("sig"),
            "file_path",
        )
    )
    packages = tx.install_pkgs(F.col("call.command"))
    extension = F.nullif(tx.file_ext(F.col("call.file")), F.lit(""))
    calls = rows.filter("size(calls) > 0").select("file_path", "turn_seq", F.explode("calls").alias("call"))
    tool_call = calls.join(ids, "file_path").select(
        "session_id",
        F.col("turn_seq").alias("after_seq"),
        F.col("call.tool").alias("tool"),
        F.when(F.col("call.command") != "", tx.command_key(F.col("call.command"), home)).alias("cmd_key"),
        extension.alias("file_ext"),
        tx.redact(F.col("call.workdir"), home).alias("workdir"),
        F.when(F.size(packages) > 0, packages).alias("pkgs"),
        "file_path",
    )
    return Tables(session, message, tool_call)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Records from a table conv_id, turn, role, text, one conversation as one file."""
    none = F.lit(None).cast("string")
    calls = F.lit(None).cast("array<struct<tool: string, command: string, file: string, workdir: string>>")
    return conversations.select(
        F.col("conv_id").cast("string").alias("file_path"),
        F.col("turn").alias("line_no"),
        F.col("conv_id").cast("string").alias("stem"),
        F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("other").alias("kind"),
        none.alias("ts"),
        F.when(F.col("role") == "user", F.col("text")).alias("text"),
        none.alias("native_id"),
        none.alias("cwd"),
        none.alias("model"),
        none.alias("originator"),
        F.lit(0).cast("bigint").alias("tokens"),
        F.lit(False).alias("cumulative"),
        calls.alias("calls"),
        F.lit(False).alias("delegated"),
    )
