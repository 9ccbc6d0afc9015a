"""Open sessions as a stream: lines arrive batch by batch, a stateful operator carries what their order decides.

State is kept for each file: the running numbers, whether the last turn was the
assistant's, first and last values, counts, and votes for the project.  Each
batch's rows go into the store by one commit, which also notes the batch's
number: a batch that is delivered again after a failure is not applied again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logloom.functions import text as tx
from logloom.operators import sessions
from logloom.plans.store import Store
from logloom.sources.registry import Source

PAYLOAD = "ts string, prompt string, is_task boolean, calls array<struct<tool: string, command: string, file: string, workdir: string>>"
FILE = (
    "file_path string, stem string, native_id string, cwd string, model string, originator string, started_at string, ended_at string, "
    "n_user long, n_asst long, out_tokens long, has_task boolean, delegated boolean, hint string"
)
OUT = "file_path string, line_no long, seq long, turn_seq long, after_assistant boolean, payload string, file string"
LAST = ("native_id", "cwd", "model", "originator")


def fresh(file_path: str, stem: str) -> dict[str, Any]:
    """The state of a file before its first line."""
    return {
        "line": -1, "seq": 0, "turn_seq": 0, "after": False, "votes": [], "total": 0, "peak": 0, "cumulative": False,
        "file": {"file_path": file_path, "stem": stem, "n_user": 0, "n_asst": 0, "has_task": False, "delegated": False},
    }


def advance(state: dict[str, Any], row: Any) -> tuple[int, int, bool]:
    """Takes one line into the state; returns its seq, turn_seq and after_assistant."""
    file, after = state["file"], state["after"]
    state["line"] = int(row.line_no)
    if row.kind == "assistant" or row.accepted:
        state["seq"] += 1
    if row.kind == "assistant":
        state["turn_seq"] = state["seq"]
        file["n_asst"] += 1
    if row.accepted:
        file["n_user"] += 1
    if row.kind in ("user", "assistant"):
        state["after"] = row.kind == "assistant"
    file["has_task"] |= bool(row.is_task)
    file["delegated"] |= bool(row.delegated)
    for name in LAST:
        if isinstance(value := getattr(row, name), str) and value:
            file[name] = value
    if row.dated:
        file.setdefault("started_at", row.ts)
        file["ended_at"] = row.ts
    if not pd.isna(row.tokens):
        state["total"] += int(row.tokens)
        state["peak"] = max(state["peak"], int(row.tokens))
    state["cumulative"] |= bool(row.cumulative)
    file["out_tokens"] = state["peak"] if state["cumulative"] else state["total"]
    for hint in json.loads(row.hints) if isinstance(row.hints, str) else []:
        held = next((v for v in state["votes"] if v[0] == hint), None)
        if held is None:
            state["votes"].append([hint, 1])
        else:
            held[1] += 1
    if state["votes"]:
        file["hint"] = max(state["votes"], key=lambda v: v[1])[0]  # the first of equals
    return state["seq"], state["turn_seq"], after


class Sessions(StatefulProcessor):
    """The lines of a file in order, each with its running values; the last one of a batch also with the file's state.

    A line whose number isn't above the last one's was seen before and is left out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("session", "value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values("line_no")
        state = json.loads(self.held.get()[0]) if self.held.exists() else fresh(key[0], lines["stem"].iloc[0])
        out = []
        for row in lines.itertuples():
            if row.line_no > state["line"]:
                out.append((key[0], row.line_no, *advance(state, row), row.payload, None))
        self.held.update((json.dumps(state),))
        found = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        if len(found):
            found.loc[found.index[-1], "file"] = json.dumps(state["file"])
        yield found

    def close(self) -> None:
        pass


def carried(lines: DataFrame, source: Source, home: str | None = None) -> DataFrame:
    """The stream of lines (file_path, line_no, line) as rows of OUT."""
    records = source.normalise(lines.select("file_path", "line_no", F.try_parse_json("line").alias("rec")).filter("rec is not null"))
    user = F.col("kind") == "user"
    marked = records.withColumn("prompt", F.when(user & sessions.accepted(F.col("text")), tx.unwrap(F.col("text"))))
    marked = marked.withColumn("is_task", tx.is_task_prompt(F.col("prompt")))
    found = F.flatten(F.transform(F.coalesce("calls", F.array().cast(records.schema["calls"].dataType)), lambda c: sessions.hints(c, home)))
    rows = marked.select(
        "file_path", "line_no", "stem", "kind", F.col("prompt").isNotNull().alias("accepted"), "is_task", "ts", tx.parse_ts(F.col("ts")).isNotNull().alias("dated"), *LAST, "tokens", "cumulative", "delegated",
        F.to_json(found).alias("hints"), F.to_json(F.struct("ts", "prompt", "is_task", "calls")).alias("payload"),
    )
    return rows.groupBy("file_path").transformWithStateInPandas(Sessions(), OUT, "append", "none")


def follow(store: Store, lines: DataFrame, source: Source, checkpoint: str, home: str | None = None, name: str | None = None, available: bool = True) -> StreamingQuery:
    """Starts a query that puts a stream of lines (file_path, line_no, line) into the store.

    Lines of a file come in the order of their numbers, spread over any number
    of batches.  Files of one session id aren't told apart.  With ``available``
    the query ends when nothing is left to read.
    """
    spark, note = store.spark, f"stream-{name or source.name}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def apply(batch: DataFrame, k: int) -> None:
        held = batch.persist()
        n = held.count()  # all of it, so that the state of every partition is committed
        if n and store.notes().get(note, -1) < k:
            rows = held.select("file_path", "line_no", "seq", "turn_seq", "after_assistant", F.from_json("payload", PAYLOAD).alias("p")).select("*", "p.*").drop("p")
            files = held.filter("file is not null").select(F.from_json("file", FILE).alias("f")).select("f.*")
            store.append(sessions.tables(rows, source.name, source.prefix, home, files=files), {note: k})
        held.unpersist()

    writer = carried(lines, source, home).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available else writer).start()
