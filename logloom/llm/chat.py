"""Chat formatting with DataFrame functions only.

A conversation's turns are collected as structs, sorted, and cut into the
segments of one training text.  Adjacent turns of a role share one block: only
the first opens it, only the last closes it, and a control string stands
between.  Control strings inside texts and role names get a backslash after
their first character (and one more for each they have), so the control
strings of an output are the template's own and the escape can be taken back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).  None holds "<" or "[" beyond its first character.
BEGIN, NEXT, ROLE, ROLE_END = "<s>", "[NEXT]", "[ROLE]", "[/ROLE]"
BLOCKS: dict[str, tuple[str, str]] = {"user": ("[INST] ", " [/INST]"), "assistant": ("[REPLY] ", "</s>"), "system": ("[SYS] ", " [/SYS]")}
#: A block of any other role: [ROLE]its name[/ROLE] text[END].
OTHER_END = "[END]"
#: Role whose texts the loss covers.
TRAINED = "assistant"
#: What stands behind the first character of a control string, for regular expressions that Java and RE2 read alike.
CONTROLS: list[tuple[str, str]] = [("<", r"\\*/?s>"), (r"\[", r"\\*/?(?:INST|REPLY|SYS|NEXT|ROLE|END)\]")]
#: Texts of the conversation that the query adds to the table.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    for first, rest in CONTROLS:
        text = F.regexp_replace(text, f"({first})({rest})", r"$1\\$2")
    return text


def unescaped(text: Column) -> Column:
    for first, rest in CONTROLS:
        text = F.regexp_replace(text, rf"({first})\\({rest})", "$1$2")
    return text


def _opened(role: Column) -> Column:
    out = F.concat(F.lit(ROLE), escaped(role), F.lit(ROLE_END + " "))
    for name, (opens, _) in BLOCKS.items():
        out = F.when(role == name, opens).otherwise(out)
    return out


def _closed(role: Column) -> Column:
    out = F.lit(OTHER_END)
    for name, (_, closes) in BLOCKS.items():
        out = F.when(role == name, closes).otherwise(out)
    return out


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of conversations(conv_id, turn, role, text): conv_id, segments, formatted.

    segments is an array of (text, loss), whose texts in a row are formatted;
    loss marks the texts of assistant turns, without any control string.  Turns
    go by turn, then role, then text, nulls first, so ties have one order and
    rows that repeat are turns of their own.  A null role or text counts as
    empty; rows with a null conv_id are one conversation; an empty table gives
    no rows; other columns are ignored.  A conversation is one row of the
    result and so must fit one; its work grows with its length.
    """
    said = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    turns = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # a run of a role has one opening and one closing, whatever the number of its turns
    other = F.transform("turns", lambda t, i: F.struct(
        t["role"].alias("role"), t["text"].alias("text"),
        ((i == 0) | (F.get("turns", i - 1)["role"] != t["role"])).alias("opens"),
        ((i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])).alias("closes"),
    ))
    runs = turns.select("conv_id", other.alias("runs"))
    parts = F.flatten(F.transform("runs", lambda t: F.array(
        F.struct(F.when(t["opens"], _opened(t["role"])).otherwise(NEXT).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t["text"]).alias("text"), (t["role"] == TRAINED).alias("loss")),
        F.struct(F.when(t["closes"], _closed(t["role"])).otherwise("").alias("text"), F.lit(False).alias("loss")),
    )))
    begin = F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss")))
    cut = runs.select("conv_id", F.concat(begin, F.filter(parts, lambda s: s["loss"] | (s["text"] != ""))).alias("segments"))
    return cut.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), turn by turn, from a formatted text alone."""
    heads = [opens.strip() for opens, _ in BLOCKS.values()] + [ROLE]
    blocks = F.split(F.substring(formatted, len(BEGIN) + 1, 1 << 30), "(?=" + "|".join(h.replace("[", r"\[").replace("]", r"\]") for h in heads) + ")")

    def body(b: Column, opens: int, closes: str) -> Column:
        return F.substring(b, F.lit(opens + 1), F.length(b) - (opens + len(closes)))

    def read(b: Column) -> Column:
        name = F.substring_index(F.substring(b, len(ROLE) + 1, 1 << 30), ROLE_END, 1)
        rest = F.substring(b, F.length(name) + (len(ROLE) + len(ROLE_END) + 2), F.length(b))
        role, texts = unescaped(name), body(rest, 0, OTHER_END)
        for known, (opens, closes) in BLOCKS.items():
            mine = b.startswith(opens)
            role, texts = F.when(mine, F.lit(known)).otherwise(role), F.when(mine, body(b, len(opens), closes)).otherwise(texts)
        own = F.split(texts, r"\[NEXT\]")
        return F.transform(own, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), read))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table's turns, and a conversation PROBE_ID whose texts are control strings."""
    own = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    probe = conversations.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return own.union(probe)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, read back from them."""
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def oracle_sql() -> str:
    """The digests over DuckDB's view conversations, from its rows; formatted_chars from the template's lengths."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def size(c: str) -> str:
        for first, rest in CONTROLS:
            c = f"regexp_replace({c}, {q(f'({first})({rest})')}, {q(chr(92).join(['', '1' + chr(92) * 2, '2']))}, 'g')"
        return f"length({c})"

    def by_role(known: int, other: str) -> str:
        return "CASE role " + " ".join(f"WHEN {q(r)} THEN {len(m[known])}" for r, m in BLOCKS.items()) + f" ELSE {other} END"

    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, turn, role, {q(PROBE_TEXT)} FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
placed AS (
  SELECT *, row_number() OVER w AS nth, coalesce(lag(role) OVER w <> role, true) AS opens, coalesce(lead(role) OVER w <> role, true) AS closes
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, {size("text")} + CASE WHEN opens THEN {by_role(0, f"{len(ROLE) + len(ROLE_END) + 1} + {size('role')}")} ELSE {len(NEXT)} END
    + CASE WHEN closes THEN {by_role(1, str(len(OTHER_END)))} ELSE 0 END AS chars FROM placed),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS said,
    coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = {q(TRAINED)}), '') AS loss, {len(BEGIN)} + sum(chars)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM told"""
