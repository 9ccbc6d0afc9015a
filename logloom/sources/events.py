"""Source with records of session_meta, turn_context, event_msg and response_item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.sources.blocks import get, stem


def normalise(lines: DataFrame) -> DataFrame:
    """Records of the shape that operators.sessions expects."""
    kind, sub = get("rec", "$.type"), get("rec", "$.payload.type")
    meta, context = kind == "session_meta", kind == "turn_context"
    user = (kind == "event_msg") & (sub == "user_message")
    assistant = (kind == "event_msg") & (sub == "agent_message")
    count = (kind == "event_msg") & (sub == "token_count")
    call = (kind == "response_item") & (sub == "function_call")
    usage = "$.payload.info.total_token_usage"
    tokens = F.coalesce(get("rec", f"{usage}.output_tokens", "bigint"), F.lit(0)) + F.coalesce(get("rec", f"{usage}.reasoning_output_tokens", "bigint"), F.lit(0))
    # the arguments are JSON in a string; a command may be a string or a list
    args = lines.withColumn("args", F.try_parse_json(get("rec", "$.payload.arguments")))
    listed = F.array_join(F.coalesce(F.try_variant_get("args", "$.cmd", "array<string>"), F.try_variant_get("args", "$.command", "array<string>")), " ")
    plain = F.coalesce(get("args", "$.cmd"), get("args", "$.command"))
    command = F.coalesce(listed, plain)
    workdir = F.coalesce(get("args", "$.workdir"), get("args", "$.cwd"))
    tool = F.concat(F.lit("codex:"), F.coalesce(get("rec", "$.payload.name"), F.lit("?")))
    none = F.lit(None).cast("string")
    one = F.array(F.struct(tool.alias("tool"), command.alias("command"), none.alias("file"), workdir.alias("workdir")))
    return args.select(
        "file_path",
        "line_no",
        stem().alias("stem"),
        F.when(user, "user").when(assistant, "assistant").otherwise("other").alias("kind"),
        get("rec", "$.timestamp").alias("ts"),
        F.when(user, F.coalesce(get("rec", "$.payload.message"), F.lit(""))).alias("text"),
        F.when(meta, get("rec", "$.payload.id")).alias("native_id"),
        F.when(meta | context, get("rec", "$.payload.cwd")).alias("cwd"),
        F.when(context, get("rec", "$.payload.model")).alias("model"),
        F.when(meta, get("rec", "$.payload.originator")).alias("originator"),
        F.when(count, tokens).alias("tokens"),
        F.lit(True).alias("cumulative"),
        F.when(call, one).alias("calls"),
        F.lit(False).alias("delegated"),
    )
