"""Report figures, and the sections that the Markdown and HTML sinks show.

Figures over tables are DataFrame operations.  A report is made on the driver
from the collected documents (digest, clusters, profile), which are small by
their definitions: a list of sections, each with a heading, figures, bars and
lines.  The sinks only lay sections out.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import lexicon as lx

DISCUSS_SHARE = 0.05
SHOWN = 12


def family_share(models: DataFrame, pattern: str) -> DataFrame:
    """Share of models(model, n) whose name matches."""
    return models.agg((F.coalesce(F.sum(F.when(F.col("model").rlike(pattern), F.col("n"))), F.lit(0)) / F.greatest(F.lit(1), F.sum("n"))).alias("share"))


def relative_to_max(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds bar, the count as a part of the largest."""
    top = counts.agg(F.max(n).alias("_max"))
    return counts.crossJoin(F.broadcast(top)).select(*counts.columns, (F.col(n) / F.greatest(F.lit(1), "_max")).alias("bar"))


@dataclass(frozen=True)
class Bar:
    label: str
    n: float
    width: float  # as a part of the longest, or of the whole
    shown: str = ""


@dataclass
class Section:
    title: str
    figures: list[tuple[str, str]] = field(default_factory=list)
    bars: dict[str, list[Bar]] = field(default_factory=dict)
    lines: list[str] = field(default_factory=list)


def abbreviated(n: float) -> str:
    """1234 as 1.2k, 2500000 as 2.5M."""
    for unit, sign in ((1e6, "M"), (1e3, "k")):
        if n >= unit:
            return f"{n / unit:.1f}{sign}"
    return str(n)


def shortened(text: str, width: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= width else flat[:width] + "…"


def percent(part: float | None) -> str:
    return f"{round((part or 0) * 100)}%"


def ranked(counts: dict[str, int], k: int = SHOWN, of_whole: bool = False) -> list[Bar]:
    """The k largest counts; bars are parts of the largest, or of the sum."""
    full = max(1, sum(counts.values()) if of_whole else max(counts.values(), default=1))
    best = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:k]
    return [Bar(name, n, n / full, percent(n / full) if of_whole else str(n)) for name, n in best]


def named(items: list[dict[str, Any]], key: str = "name") -> dict[str, int]:
    return {i[key]: i["n"] for i in items}


def totals(digest: dict[str, Any]) -> dict[str, int]:
    """Own sessions, delegated ones and output tokens over all sources."""
    parts = {"own": digest.get("per_source"), "delegated": digest.get("meta", {}).get("meta_sessions_skipped"), "tokens": digest.get("output_tokens_est")}
    return {name: sum((counts or {}).values()) for name, counts in parts.items()}


def themed(candidates: list[dict[str, Any]]) -> list[tuple[str, list[dict[str, Any]]]]:
    """Quotes by the first theme that matches, in the order of themes; without a match under the last one."""
    rules = [(name, re.compile(pattern)) for name, pattern in lx.REPORT_THEMES]
    groups: dict[str, list[dict[str, Any]]] = {name: [] for name, _ in [*rules, (lx.REPORT_OTHER, None)]}
    for c in candidates:
        groups[next((name for name, rule in rules if rule.search(c["quote"])), lx.REPORT_OTHER)].append(c)
    return [(name, own) for name, own in groups.items() if own]


def telling(clusters: list[dict[str, Any]], k: int = 8) -> list[dict[str, Any]]:
    """The first k clusters whose representative says something."""
    bare = [(re.sub(r"\s", "", c.get("representative") or ""), c) for c in clusters]
    return [c for text, c in bare if len(text) >= 16 and not re.match(lx.FILLER_OPENER, text)][:k]


def sound(clusters: list[dict[str, Any]], k: int = 8) -> list[dict[str, Any]]:
    """The first k clusters whose representative is no heading, key or left-over of a tool."""
    return [c for c in clusters if not re.search(lx.JUNK_CLUSTER, c.get("representative") or "")][:k]


def rules(profile: dict[str, Any], least: int = 2) -> list[dict[str, Any]]:
    """Themes of repeated corrections that may become rules."""
    return [t for t in profile.get("friction_themes", []) if t["theme"] != lx.PROFILE_OTHER and t["n"] >= least]


def top_family(models: dict[str, int], pattern: str = lx.TOP_FAMILY) -> float:
    return sum(n for name, n in models.items() if re.search(pattern, name)) / max(1, sum(models.values()))


def _of_digest(d: dict[str, Any], insights: list[str]) -> list[Section]:
    t, span = totals(d), [x or "" for x in d.get("meta", {}).get("span") or ["", ""]]
    hours, days = d["temporal"]["by_hour"], d["temporal"]["by_weekday"]
    projects = d.get("projects", [])
    shares = [Bar(p["cwd"], p["sessions"], p["share"], percent(p["share"])) for p in projects[:6]]
    rest = 1 - sum(p["share"] for p in projects[:6])
    if rest > 0.001:
        shares.append(Bar(f"other ({max(0, len(projects) - 6)})", 0, rest, percent(rest)))
    friction = d.get("friction_candidates", [])
    return [
        Section("Overview", [("Span", " – ".join(span)), ("Own sessions", abbreviated(t["own"])), ("Delegated sessions", abbreviated(t["delegated"])), ("Output tokens", "≈" + abbreviated(t["tokens"]))]),
        Section(
            "Hours and days",
            [("Peak hour", str(hours.index(max(hours)))), ("Peak day", lx.WEEKDAYS[days.index(max(days))])],
            {"Messages by hour": [Bar(str(i), n, n / max(1, *hours), str(n)) for i, n in enumerate(hours)], "Messages by day": [Bar(lx.WEEKDAYS[i], n, n / max(1, *days), str(n)) for i, n in enumerate(days)]},
        ),
        Section("Models", [("Share of the top family", percent(top_family(d.get("models", {}))))] + [(f"Output tokens, {k}", "≈" + abbreviated(n)) for k, n in d.get("output_tokens_est", {}).items()], {"Sessions by model": ranked(d.get("models", {}), 8, of_whole=True)}),
        Section("Projects", [("Largest", f"{projects[0]['cwd'].split('/')[-1]} {percent(projects[0]['share'])}")] if projects else [], {"Sessions by project": shares}),
        Section("Commands and files", [], {"Commands": ranked(named(d.get("commands_top", []), "cmd")), "Edited file types": ranked(d.get("edited_filetypes", {}))}),
        Section("Corrections", [("Candidates", str(len(friction)))], {}, [f"{name} ({len(own)}): " + "; ".join(f"“{shortened(c['quote'], 68)}” [{c['source']}]" for c in own[:5]) for name, own in themed(friction)]),
        Section("Insights", [], {}, list(insights)),
    ]


def _of_clusters(found: dict[str, Any], chosen: Callable[[list[dict[str, Any]]], list[dict[str, Any]]]) -> Section:
    figures = [("Tasks", str(found.get("n_tasks", 0))), ("Only once", str(found.get("n_singletons", 0))), ("Method", str(found.get("mode", "none")))]
    lines = [f"{c['size']}× {shortened(c['representative'], 90)}" + (f" ({' · '.join(c['top_terms'][:5])})" if c.get("top_terms") else "") for c in chosen(found.get("clusters", []))]
    return Section("Recurring tasks", figures, {}, lines)


def _of_profile(p: dict[str, Any]) -> list[Section]:
    style, stack, checks = p["prompting_style"], p["stack_fingerprint"], p["verification_habits"]
    ratio = checks.get("test_to_edit_ratio")
    proposals = [f"{t['theme']} ({t['n']})" + (f": “{shortened(t['quotes'][0], 52)}”" if t.get("quotes") else "") for t in rules(p)]
    if style.get("discuss_first_rate", 0) >= DISCUSS_SHARE:
        proposals.append(f"Discuss first, then write ({percent(style['discuss_first_rate'])} of prompts)")
    return [
        Section("Stack", [], {"Packages installed": ranked(named(stack.get("packages_installed", []))), "Libraries mentioned": ranked(named(stack.get("libs_mentioned", []))), "Package managers": ranked(stack.get("package_managers", {})), "Languages": ranked(stack.get("languages", {}))}),
        Section(
            "Prompts",
            [("Prompts", abbreviated(style.get("n_prompts", 0))), ("Median length", str(style.get("median_chars"))), ("CJK", percent(style.get("cjk_share"))), ("With acceptance criteria", percent(style.get("acceptance_rate"))), ("Discussion first", percent(style.get("discuss_first_rate")))],
            {"Lengths": ranked(style.get("length_mix") or {}, of_whole=True)},
        ),
        Section("Verification", [("Edits", abbreviated(checks.get("edits", 0))), ("Commits", abbreviated(checks.get("commits", 0))), ("Tests to edits", "—" if ratio is None else str(ratio))], {"Commands by kind": ranked(checks.get("buckets", {}))}),
        Section("Candidate rules", [], {}, proposals),
    ]


def sections(document: dict[str, Any], chosen: Callable[[list[dict[str, Any]]], list[dict[str, Any]]] = telling) -> list[Section]:
    """What a report of document (digest, clusters, profile, insights; any may be missing) shows, empty sections left out.

    ``chosen`` picks the clusters: the page shows telling ones, Markdown all sound ones.
    """
    found: list[Section] = []
    if document.get("digest"):
        found += _of_digest(document["digest"], document.get("insights") or [])
    if document.get("clusters"):
        found.append(_of_clusters(document["clusters"], chosen))
    if document.get("profile"):
        found += _of_profile(document["profile"])
    return [s for s in found if s.figures or s.lines or any(s.bars.values())]


def markdown(document: dict[str, Any], generated: str = "—") -> str:
    out = ["# Profile of habits", f"> generated {generated}"]
    for s in sections(document, sound):
        out += ["", f"## {s.title}"]
        out += [f"- {label}: **{value}**" for label, value in s.figures]
        out += [f"- {title}: " + " · ".join(f"{b.label} ({b.shown})" for b in bars) for title, bars in s.bars.items() if bars]
        out += [f"- [ ] {x}" if s.title == "Candidate rules" else f"- {x}" for x in s.lines]
    return "\n".join(out) + "\n"


_STYLE = "body{font:16px/1.5 Georgia,serif;max-width:60em;margin:2em auto;padding:0 1em}dl{display:flex;flex-wrap:wrap;gap:1em 2em}dt{color:#666}dd{margin:0;font-size:1.4em}.row{display:flex;gap:.6em}.row i{background:#a23b1e;height:.9em;align-self:center}.row b{font-weight:400;min-width:14em}"


def page(document: dict[str, Any], title: str = "logloom") -> str:
    """One HTML page with the sections; it also holds the document as JSON.  It is laid out here and loads no other document."""

    def text(x: object) -> str:
        return html.escape(str(x))

    body = []
    for s in sections(document):
        figures = "".join(f"<div><dt>{text(k)}</dt><dd>{text(v)}</dd></div>" for k, v in s.figures)
        bars = "".join(
            f"<h3>{text(name)}</h3>" + "".join(f'<div class=row><b>{text(b.label)}</b><i style="width:{max(0.0, min(1.0, b.width)) * 20:.2f}em"></i>{text(b.shown)}</div>' for b in own) for name, own in s.bars.items() if own
        )
        lines = "".join(f"<li>{text(x)}</li>" for x in s.lines)
        body.append(f"<section><h2>{text(s.title)}</h2>" + (f"<dl>{figures}</dl>" if figures else "") + bars + (f"<ul>{lines}</ul>" if lines else "") + "</section>")
    data = json.dumps(document, ensure_ascii=False, default=str).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>{text(title)}</title><style>{_STYLE}</style><h1>{text(title)}</h1>{''.join(body)}<script type=application/json id=data>{data}</script>"
