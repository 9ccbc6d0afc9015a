"""Source with records of type user and assistant whose content is a string or typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import lexicon as lx


def get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def stem() -> Column:
    """The file's name without its ending; Spark gives paths as URIs."""
    name = F.regexp_replace(F.regexp_extract("file_path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def message_text() -> Column:
    """The content if it is a string; of a list the text blocks, one to a line."""
    is_text = F.schema_of_variant(F.try_variant_get("rec", "$.message.content", "variant")) == "STRING"
    listed = F.coalesce(F.try_variant_get("rec", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(
        F.filter(listed, lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")),
    )
    return F.when(is_text, get("rec", "$.message.content")).otherwise(F.array_join(texts, "\n"))


def normalise(lines: DataFrame) -> DataFrame:
    """Records of the shape that operators.sessions expects."""
    kind = get("rec", "$.type")
    tools = F.filter(F.coalesce(F.try_variant_get("rec", "$.message.content", "array<variant>"), F.array().cast("array<variant>")), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")

    def call(b: Column) -> Column:
        tool = F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("?"))
        return F.struct(
            tool.alias("tool"),
            F.when(tool == "Bash", F.coalesce(F.try_variant_get(b, "$.input.command", "string"), F.lit(""))).alias("command"),
            F.when(tool.isin(lx.EDIT_TOOLS), F.try_variant_get(b, "$.input.file_path", "string")).alias("file"),
            F.lit(None).cast("string").alias("workdir"),
        )

    user, assistant = kind == "user", kind == "assistant"
    none = F.lit(None).cast("string")
    return lines.select(
        "file_path",
        "line_no",
        stem().alias("stem"),
        F.when(user, "user").when(assistant, "assistant").otherwise("other").alias("kind"),
        get("rec", "$.timestamp").alias("ts"),
        F.when(user, message_text()).alias("text"),
        none.alias("native_id"),
        get("rec", "$.cwd").alias("cwd"),
        F.when(assistant, get("rec", "$.message.model")).alias("model"),
        none.alias("originator"),
        F.when(assistant, F.coalesce(get("rec", "$.message.usage.output_tokens", "bigint"), F.lit(0))).alias("tokens"),
        F.lit(False).alias("cumulative"),
        F.when(assistant, F.transform(tools, call)).alias("calls"),
        stem().startswith("agent-").alias("delegated"),
    )
