"""A stream of lines in several batches gives the tables of one batch ingest, across a restart."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_ingest import A, B, assistant, rows, tool, user, write  # noqa: F401

from logloom.plans.store import Store
from logloom.streaming import follow

pytest.importorskip("google.protobuf")

HOME = "/home/me"


def session_a(seed):
    said = [user(f"please build module {seed} of the larger system", cwd="/home/me/Projects/web/src", timestamp="2024-01-01T10:00:00Z")]
    said += [assistant(tool("Bash", command="cd /srv/q/r && npm i react@18"), tool("Edit", file_path="/home/me/Projects/web/a.TS"), tokens=7), {"type": "system"}]
    said += [user("no, that's not what i meant here", timestamp="2024-01-01T11:00:00Z"), "{bad", assistant(tool("Bash", command="pytest -q")), user([{"type": "tool_result", "content": "ok"}])]
    return said + [user("revert everything about layout please", timestamp="bad time"), assistant(model="m-2", tokens=3), user("thanks for all of it", timestamp="2024-01-02T09:00:00+02:00")]


def session_b():
    event = lambda **p: {"type": "event_msg", "timestamp": "2024-01-03T00:30:00Z", "payload": p}
    count = lambda n: event(type="token_count", info={"total_token_usage": {"output_tokens": n, "reasoning_output_tokens": 0}})
    call = {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["git", "commit"], "workdir": "/srv/q/r"})}}
    own = [event(type="user_message", message="write the whole parser for long tables"), count(10), event(type="agent_message"), call, count(25)]
    # the id comes late: what was stored under the file's name moves along
    return own + [{"type": "session_meta", "payload": {"id": "abc", "cwd": "~", "originator": "term"}}, event(type="user_message", message="and now test all of it"), event(type="agent_message"), call, count(40)]


def lines(path):
    with open(path, encoding="utf-8") as f:
        return [(f"file:{path}", n, line.rstrip("\n")) for n, line in enumerate(f)]


@pytest.mark.parametrize("source", [A, B])
def test_batches_equal_one_ingest(spark, tmp_path, source):
    made = {f"s{k}": session_a(k) for k in range(3)} if source is A else {"r1": session_b()}
    for name, records in made.items():
        write(f"{tmp_path}/logs/{name}.jsonl", *records)
    whole = Store(spark, str(tmp_path / "whole"))
    whole.ingest([(source, f"{tmp_path}/logs")], home=HOME)
    st, feed = Store(spark, str(tmp_path / "store")), str(tmp_path / "feed")
    every = [x for name in made for x in lines(f"{tmp_path}/logs/{name}.jsonl")]
    for k in range(3):  # each call is a new query that goes on from the checkpoint; the middle one also gets old lines again
        part = [x for x in every if x[1] % 10 // 4 == k or (k == 1 and x[1] < 2)]
        spark.createDataFrame(part, "file_path string, line_no long, line string").repartition(2).write.mode("append").parquet(feed)
        stream = spark.readStream.schema("file_path string, line_no long, line string").parquet(feed)
        assert follow.follow(st, stream, source, str(tmp_path / "state"), HOME).awaitTermination(240)
    for t in ("session", "message", "tool_call"):
        assert rows(st.table(t).drop("ingested_at"), "*") == rows(whole.table(t).drop("ingested_at"), "*"), t
    assert st.table("message").count() >= 2 and st.health()["status"] == "healthy"
    last = st.notes()[f"stream-{source.name}"]
    assert last >= 2
    # a batch that comes again after its commit changes nothing
    before = rows(st.table("tool_call"), "*")
    st.commit({}, {f"stream-{source.name}": 10**6})
    spark.createDataFrame([(f"file:{tmp_path}/logs/new.jsonl", 0, json.dumps(session_a(9)[0]))], "file_path string, line_no long, line string").write.mode("append").parquet(feed)
    assert follow.follow(st, spark.readStream.schema("file_path string, line_no long, line string").parquet(feed), source, str(tmp_path / "state"), HOME).awaitTermination(240)
    assert rows(st.table("tool_call"), "*") == before and st.table("session").filter(F.col("file_path").contains("new")).count() == 0
    assert os.path.exists(st.path)
