"""Digests from kept partials equal those from the tables, and read changed parts only."""

import json
import os
import random

from pyspark.sql import functions as F

from logloom.operators import digest, habits, partials
from logloom.plans.kept import Kept
from logloom.plans.store import Store
from logloom.sources.registry import SOURCES

SAID = ["please write the whole parser module", "no, that's not what i meant here", "必须把这个页面的布局改好看一点", "revert everything about layout please", "status", "fix the tests before anything else", "no, that's not what i meant here at all"]
COMMANDS = ["git commit -m x", "pytest -q", "npm i react@18", "cd /srv/q/r && ls", "make all"]


def write(root, r, name):
    lines = []
    for k in range(r.randint(1, 9)):
        stamp = f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}T{r.randint(10, 23)}:00:00Z" if r.random() < 0.9 else "bad"
        lines.append({"type": "user", "timestamp": stamp, "cwd": f"/home/me/Projects/p{r.randint(0, 3)}", "message": {"content": r.choice(SAID)}})
        calls = [{"type": "tool_use", "name": r.choice(["Bash", "Bash", "Edit"]), "input": {"command": r.choice(COMMANDS), "file_path": f"a.{r.choice(['py', 'ts'])}"}} for _ in range(r.randint(0, 2))]
        lines.append({"type": "assistant", "message": {"model": f"m-{r.randint(0, 2)}", "usage": {"output_tokens": r.randint(0, 50)}, "content": calls}})
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/{name}.jsonl", "w", encoding="utf-8") as f:
        f.writelines(json.dumps(x, ensure_ascii=False) + "\n" for x in lines)


def test_digests_after_ingests(spark, tmp_path):
    r, root = random.Random(3), str(tmp_path / "logs")
    st = Store(spark, str(tmp_path / "store"))
    kept = Kept(st)
    assert kept.digest()["meta"]["sessions"] == 0
    names = [f"s{k}" for k in range(25)] + ["agent-1"]
    for k in range(4):
        for name in names if k == 0 else r.sample(names, 2):
            write(root, r, name)
        st.ingest([(SOURCES[0], root)])
        read, table = [], st.table
        st.table = lambda t, parts=None: read.append((t, parts)) or table(t, parts)  # noqa: B023
        found = kept.digest()
        del st.table
        if k:
            assert {t for t, _ in read} == {"session", "message", "tool_call"} and all(parts and len(parts) <= 2 for _, parts in read)
        assert found == digest.build(st.tables())
        assert len(found["task_prompts"]) > 1 and found["friction_candidates"] and kept.refresh() == []
    real = st.table("message").join(st.table("session").filter("kind = 'real'").select(F.col("id").alias("session_id")), "session_id")
    assert partials.style(kept.rows()).first() == habits.style(real.filter("role = 'user'")).first()
    assert len(kept._found()) == len(kept._names())
