"""Log sources: a name, the place of the files, and a normaliser."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from logloom.sources import blocks, events


@dataclass(frozen=True)
class Source:
    """normalise: lines(file_path, line_no, rec) -> records for operators.sessions."""

    name: str
    root: str
    normalise: Callable[[DataFrame], DataFrame]
    prefix: str


#: Adding a source is one module and one entry here.
SOURCES = [
    Source("claude-code", "~/.claude/projects", blocks.normalise, "cc"),
    Source("codex", "~/.codex/sessions", events.normalise, "cx"),
]
