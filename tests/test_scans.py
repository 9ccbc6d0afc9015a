"""Large files in many splits, long sessions in segments, and digests in chunks, against the plain forms."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import scans, sessions
from logloom.plans.store import Store
from logloom.sources import blocks, jsonl
from logloom.sources.registry import SOURCES

ENDS = ["\n", "\r\n", "\r"]


@pytest.fixture
def logs(tmp_path):
    r, root = random.Random(6), tmp_path / "a b+c"
    os.makedirs(root)
    for k in range(4):
        end = ENDS[k % 3]
        lines = [r.choice(["", "   ", "{bad", "[1]", json.dumps({"type": r.choice(["user", "assistant", "system"]), "message": {"content": "é" * r.randint(0, 40) + f" write module {i}"}}, ensure_ascii=False), "\t" + json.dumps({"i": i})]) for i in range(60)]
        (root / f"s{k}.jsonl").write_bytes(end.join(lines).encode() + (end.encode() if k % 2 else b""))
    (root / "bytes.jsonl").write_bytes(b'{"a": "x\xff\xfey"}\n\xff{"b": 1}\n')
    (root / "empty.jsonl").write_bytes(b"")
    (root / "other.txt").write_bytes(b'{"a": 1}\n')
    return str(root)


def expected(root):
    out = set()
    for name in os.listdir(root):
        if not name.endswith(".jsonl"):
            continue
        text = open(f"{root}/{name}", "rb").read().decode(errors="ignore")
        for n, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            try:
                found = json.loads(line)
            except ValueError:
                continue
            if isinstance(found, dict):
                out.add((name, n, json.dumps(found, sort_keys=True)))
    return out


def read(spark, root, **more):
    rows = jsonl.read_lines(spark, root, **more).select("file_path", "line_no", F.to_json("rec").alias("rec")).collect()
    found = [(r["file_path"].split("/")[-1], r["line_no"], json.dumps(json.loads(r["rec"]), sort_keys=True)) for r in rows]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("split", [None, 200, 64])
def test_lines_of_split_files(spark, logs, split):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        if split:
            spark.conf.set(names[0], str(split))
            spark.conf.set(names[1], "1")
            assert jsonl.scan(spark, "text", logs).rdd.getNumPartitions() > 20
        assert read(spark, logs) == expected(logs)
        one = [r["file_path"] for r in jsonl.files(spark, logs).filter("file_path like '%s1.jsonl'").collect()]
        own = {x for x in expected(logs) if x[0] == "s1.jsonl"}
        assert read(spark, logs, chosen=one) == own and read(spark, logs, chosen=jsonl.files(spark, logs).filter(F.col("file_path").isin(one))) == own
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)


def test_the_scan_opens_chosen_files_only(spark, logs):
    one = [r["file_path"] for r in jsonl.files(spark, logs).filter("file_path like '%s1.jsonl'").collect()]
    plan = jsonl.only(jsonl.scan(spark, "text", logs), one)
    assert len(one) == 1 and plan.rdd.getNumPartitions() == 1 and "wholetext" not in plan._jdf.queryExecution().toString().lower()
    assert jsonl.only(jsonl.scan(spark, "text", logs), ["file:/nowhere"]).rdd.getNumPartitions() == 0


@pytest.mark.parametrize(("large", "chunk"), [(1 << 28, 1 << 20), (0, 3), (900, 7)])
def test_digests(spark, logs, large, chunk):
    found = {r["file_path"].split("/")[-1]: r["content_hash"] for r in jsonl.hashes(spark, logs, large=large, chunk=chunk).collect()}
    assert found == {n: hashlib.sha1(open(f"{logs}/{n}", "rb").read()).hexdigest() for n in os.listdir(logs) if n.endswith(".jsonl") and n != "empty.jsonl"}


@pytest.mark.parametrize("segment", [1, 2, 7, 1000])
def test_segments(spark, segment):
    r = random.Random(segment)
    lines = [(f, n, r.choice(["user", "assistant", "other"]), r.choice(["please write the whole module", "no", None, "/x"])) for f in "abc" for n in range(r.randint(1, 40))]
    records = spark.createDataFrame(lines, "file_path string, line_no long, kind string, text string").repartition(5)
    plain, cut = sessions.sequenced(records), sessions.sequenced(records, segment)
    assert sorted(map(tuple, cut.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    windows = [x for x in cut._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "line_no" in x]
    assert windows and all("_seg" in x.split("], [")[1] for x in windows)


def test_carried_without_rows(spark):
    none = spark.createDataFrame([], "k int, n long, v int")
    assert scans.carried(none, ["k"], "n", 5, {"s": F.col("v")}, {"at": (F.col("v") > 1, "s")}, {"b": F.col("v")}).collect() == []


def test_ingest_in_segments(spark, logs, tmp_path, monkeypatch):
    from logloom.plans import store as plans

    one, two = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "two"))
    one.ingest([(SOURCES[0], logs)])
    monkeypatch.setattr(plans, "LARGE_FILE", 1)
    monkeypatch.setattr(sessions, "SEGMENT", 4)
    two.ingest([(SOURCES[0], logs)])
    for t in ("session", "message", "tool_call"):
        a, b = (sorted((tuple(r) for r in s.table(t).drop("ingested_at").collect()), key=str) for s in (one, two))
        assert a == b and (a or t == "tool_call"), t
    assert one.table("session").filter("id = 'cc:s1'").count() == 1
    assert blocks.stem() is not None
