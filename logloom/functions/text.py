"""Scalars and predicates as Column functions; nothing leaves the JVM."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions import lexicon as lx


def texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def trimmed(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_match(c: Column, rules: Sequence[tuple[str, str]], otherwise: str | None, flags: str = "") -> Column:
    """Name of the first rule whose pattern is found in c."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(flags + pattern), F.lit(name)).otherwise(out)
    return out


def redact(c: Column, home: str | None = None, strict: bool = False) -> Column:
    """Keys, bearer tokens, e-mail addresses and assigned secrets masked, the home directory shortened to ~.

    strict also masks secrets in quotes.
    """
    for pattern, to in lx.REDACTIONS:
        c = F.regexp_replace(c, pattern, to)
    if strict:
        c = F.regexp_replace(c, *lx.STRICT_SECRET)
    return F.replace(c, F.lit(home or os.path.expanduser("~")), F.lit("~"))


def unwrap(c: Column) -> Column:
    """What follows the first wrapper of the list that occurs, without leading image references; trimmed."""
    out = c
    for w in reversed(lx.WRAPPERS):
        out = F.when(F.instr(c, w) > 0, F.substring(c, F.instr(c, w) + len(w), F.length(c))).otherwise(out)
    return trimmed(F.regexp_replace(out, lx.LEADING_IMAGES, ""))


def is_injected(c: Column) -> Column:
    head = F.substring(F.regexp_replace(c, r"(?U)^\s+", ""), 1, 200)
    return F.coalesce((F.length(c) == 0) | head.rlike("|".join(re.escape(m) for m in lx.INJECTED)), F.lit(True))


def is_real_prompt(c: Column) -> Column:
    t = trimmed(c)
    starts = F.lit(False)
    for p in ["/", *lx.NOT_PROMPTS]:
        starts = starts | t.startswith(p)
    return F.coalesce((F.length(t) >= 3) & ~starts, F.lit(False))


def words(c: Column) -> Column:
    """Words of a lower-cased text that aren't stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(lx.WORD), F.lit(0)), lambda w: ~w.isin(lx.STOP_WORDS))


def is_task_prompt(c: Column) -> Column:
    t = trimmed(c)
    topical = t.rlike(lx.CJK) | (F.size(F.array_distinct(words(t))) >= 3)
    return F.coalesce(is_real_prompt(c) & (F.length(t) >= 12) & topical, F.lit(False))


def is_friction(c: Column, after_assistant: Column, pattern: str = lx.CORRECTION) -> Column:
    """A short correction that follows an assistant turn and opens with the complaint."""
    return F.coalesce(after_assistant & (F.length(c) < 600) & F.substring(c, 1, 120).rlike("(?i)" + pattern), F.lit(False))


def has_acceptance(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + lx.ACCEPTANCE), F.lit(False))


def wants_discussion(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + lx.DISCUSS), F.lit(False))


def signature(c: Column, k: int = 6) -> Column:
    """The k most frequent words of three letters or more (ties: the first seen), sorted, joined by spaces."""
    own = F.filter(words(c), lambda w: F.length(w) >= 3)
    ranked = F.array_sort(F.transform(F.array_distinct(own), lambda w, i: F.struct((-F.size(F.filter(own, lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w"))))
    return F.array_join(F.array_sort(F.transform(F.slice(ranked, 1, k), lambda r: r["w"])), " ")


def project_root(path: Column, home: str | None = None) -> Column:
    """The project's directory: one level below an anchor directory, below ~, or the first two levels."""
    p = redact(F.regexp_replace(trimmed(path), "^[\"']+|[\"']+$", ""), home)
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    n = F.size(parts)
    out = F.when(n == 1, F.concat(F.lit("/"), parts[0])).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/")))
    out = F.when(F.get(parts, F.lit(0)) == "~", F.when(n >= 2, F.concat(F.lit("~/"), F.get(parts, F.lit(1))))).otherwise(out)
    for a in reversed(lx.ANCHORS):
        at = F.array_position(parts, a)
        out = F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), (at + 1).cast("int")), "/")).otherwise(out)
    return F.when(path.isNull() | (path == "") | p.isin("~", "/", ".", "") | (n == 0), F.lit(None)).otherwise(out)


def cd_targets(cmd: Column) -> Column:
    """Every target of a cd, quotes removed."""
    found = F.regexp_extract_all(cmd, F.lit(r"cd\s+(\"[^\"]+\"|'[^']+'|[^\s\"'&|;<>]+)"), F.lit(1))
    return F.transform(found, lambda t: trimmed(F.regexp_replace(t, "^[\"']|[\"']$", "")))


def command_key(cmd: Column, home: str | None = None) -> Column:
    """The first two words after a leading change of directory; null for a mere change of directory."""
    c = trimmed(F.regexp_replace(trimmed(cmd), r"^cd\s+[^&;|]+(&&|;)\s*", ""))
    return F.when(~((c == "") | (c == "cd") | c.startswith("cd ")), F.substring(redact(F.array_join(F.slice(F.split(c, r"(?U)\s+"), 1, 2), " "), home), 1, 60))


def manager(cmd_key: Column) -> Column:
    head = F.lower(F.element_at(F.split(trimmed(cmd_key), r"\s+"), 1))
    return F.when(head.isin(lx.MANAGERS), head)


def strip_version(token: Column) -> Column:
    """A package name without its version, a scope kept."""
    return F.when(token.startswith("@"), F.regexp_extract(token, "^(@[^@]*)", 1)).otherwise(F.regexp_extract(token, r"^(.*?)(?:@|==|~=|>=|<=|>|<|\[|$)", 1))


def install_pkgs(cmd: Column) -> Column:
    """Names of the packages that a command installs, each once."""
    rest = F.flatten(F.transform(F.regexp_extract_all(cmd, F.lit(lx.INSTALL), F.lit(1)), lambda r: F.filter(F.split(r, r"(?U)\s+"), lambda x: x != "")))
    named = F.filter(rest, lambda t: ~t.startswith("-") & ~t.isin(lx.INSTALL_VERBS))
    bare = F.transform(named, lambda t: F.lower(F.regexp_replace(strip_version(t), "^[\"'`,]+|[\"'`,]+$", "")))
    kept = F.filter(bare, lambda p: p.rlike("[a-z]") & (F.length(p) <= 60) & ~p.rlike(r"[$=;`{}()*]") & ~p.rlike(r"^[~./]"))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def verification(cmd_key: Column) -> Column:
    return first_match(cmd_key, lx.VERIFICATION, None)


def libraries(c: Column, names: Sequence[str] = lx.LIBRARIES, aliases: dict[str, str] = lx.LIBRARY_ALIASES) -> Column:
    """Libraries that a text names, each once, other spellings folded."""
    any_of = "|".join(re.escape(x) for x in sorted(names, key=lambda x: (-len(x), x)))
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"(?iU)(?<![\w.-])({any_of})(?![\w.-])"), F.lit(1))
    folded = found
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        folded = F.transform(found, lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.array_distinct(folded)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What then makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rare_ts(c: Column) -> Column:
    """Timestamps in any ISO-8601 form: compact dates and clocks, week dates, parts of a clock, offsets with seconds, any separator."""

    def part(x: Column, pattern: str) -> Column:
        return F.regexp_extract(x, pattern, 1)

    def first_monday(year: Column) -> Column:
        return F.date_trunc("week", F.try_to_timestamp(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")))).cast("date")

    def of_week(v: Column) -> Column:
        day = F.coalesce(F.nullif(part(v["given"], r"W\d{2}-?(\d)"), F.lit("")), F.lit("1"))
        found = F.date_add(first_monday(v["year"]), ((v["week"].try_cast("int") - 1) * 7 + day.try_cast("int") - 1).cast("int"))
        # week 53 is one only in some years
        return let(found, lambda d: F.when((first_monday(v["year"].try_cast("int") + 1) > d) & (v["week"] >= "01"), d.cast("string")))

    def clocked(v: Column) -> Column:
        plain = F.replace(v["given"], F.lit("-"), F.lit(""))
        date = F.when(v["week"] != "", of_week(v)).otherwise(F.concat_ws("-", v["year"], F.substring(plain, 5, 2), F.substring(plain, 7, 2)))
        clock = part(v["time"], r"^(\d{2}(?::\d{2}(?::(?=[+-])|:\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)(?:[+-]|$)")
        return let(F.struct(date.alias("date"), clock.alias("clock"), v["time"].alias("time"), v["sound"].alias("sound"), v["bare"].alias("bare")), zoned)

    def zoned(v: Column) -> Column:
        digits = F.replace(v["clock"], F.lit(":"), F.lit(""))
        hms, fraction = F.rpad(part(digits, r"^(\d+)"), 6, "0"), F.substring(F.rpad(part(digits, r"[.,](\d+)"), 6, "0"), 1, 6)
        local = let(hms, lambda t: F.concat(v["date"], F.lit(" "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 2), F.lit("."), fraction))
        zone = F.substring(v["time"], F.length(v["clock"]) + 1, F.length(v["time"]))
        return let(F.struct(local.alias("local"), zone.alias("zone"), (v["sound"] & (v["bare"] | (v["clock"] != ""))).alias("sound")), moved)

    def moved(v: Column) -> Column:
        known = v["sound"] & v["zone"].rlike(r"^(?:[+-]\d{2}(?::\d{2}(?::\d{2})?|\d{2}(?:\d{2})?)?)?$")
        offset = F.rpad(F.replace(F.substring(v["zone"], 2, 9), F.lit(":"), F.lit("")), 6, "0")

        def shifted(o: Column) -> Column:
            h, m, s = (F.substring(o, k, 2).try_cast("long") for k in (1, 3, 5))
            micros = (h * 3600 + m * 60 + s) * F.when(v["zone"].startswith("-"), -1_000_000).otherwise(1_000_000).cast("long")
            return F.when((h < 24) & (m < 60) & (s < 60), F.timestamp_micros(F.unix_micros(F.try_to_timestamp(F.concat(v["local"], F.lit("Z")))) - micros))

        return F.when(known, F.when(v["zone"] == "", F.try_to_timestamp(v["local"])).otherwise(let(offset, shifted)))

    def dated(given: Column) -> Column:
        sound = (given != "") & ~given.startswith("0000")
        return let(
            F.struct(given.alias("given"), F.substring(given, 1, 4).alias("year"), part(given, r"W(\d{2})").alias("week"), F.substring(c, F.length(given) + 2, F.length(c)).alias("time"), sound.alias("sound"), (F.length(c) == F.length(given)).alias("bare")),
            clocked,
        )

    return let(part(c, r"^(\d{4}-\d{2}-\d{2}|\d{4}-W\d{2}(?:-[1-7](?!\d))?|\d{8}|\d{4}W\d{2}[1-7]?)(?:[^\d]|$)"), dated)


def parse_ts(c: Column) -> Column:
    """ISO-8601 date or time in any form as a timestamp in the session's zone, which times without an offset are in; null for anything else."""
    c = F.replace(c, F.lit("Z"), F.lit("+00:00"))
    common = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?([+-]\d{2}:\d{2})?)?$") & ~c.startswith("0000")
    return F.when(common, F.try_to_timestamp(c)).otherwise(_rare_ts(c))


def file_ext(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])(\.[^.]*)$", 1))


def clean_basename(path: Column) -> Column:
    """Last segment of a path, if it may be a project's name."""
    p = trimmed(path)
    base = F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1)
    bad = (p == "") | (p == "<none>") | (F.length(base) < 2) | base.startswith(".") | base.rlike(lx.FILE_LIKE) | F.lower(base).isin(lx.GENERIC_NAMES)
    return F.when(~bad, base)


def token_cost(c: Column) -> Column:
    """Estimated tokens of a text, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3).cast("int"))


def length_class(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 40, "terse (<40)").when(n > 400, "detailed (>400)").otherwise("normal (40-400)")
