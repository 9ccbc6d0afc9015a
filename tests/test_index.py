"""The posting table: search by it equals the scan, and it follows the store's parts."""

import json
import os
import random

import pytest

from logloom.operators import postings
from logloom.plans.index import BUCKETS, Index, scanned
from logloom.plans.store import Store
from logloom.sources.registry import SOURCES

WORDS = ["parser", "Parsing", "größe", "ananas", "banana", "the", "layout", "布局页面", "🙂🙂", "a%b", "x_y", '"quoted"', "redo"]


def write(path, seed, n=6):
    r = random.Random(seed)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for k in range(n):
            said = " ".join(r.choice(WORDS) for _ in range(r.randint(3, 30)))
            f.write(json.dumps({"type": "user", "timestamp": f"2024-01-{k + 1:02d}T10:00:00Z", "message": {"content": "please " + said}}, ensure_ascii=False) + "\n")
            f.write(json.dumps({"type": "assistant", "message": {"content": []}}) + "\n")


@pytest.fixture
def store(spark, tmp_path):
    for k in range(12):
        write(f"{tmp_path}/logs/s{k}.jsonl", k)
    write(f"{tmp_path}/logs/agent-one.jsonl", 50)
    with open(f"{tmp_path}/logs/tui.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"type": "user", "message": {"content": "banana"}}) + "\n")
    st = Store(spark, str(tmp_path / "store"))
    st.ingest([(SOURCES[0], f"{tmp_path}/logs")])
    return st


QUERIES = ["ana", "anana", "BANANA", " parser ", "er pa", "布局页", "🙂🙂", "größe", "a%b", '"quoted"', "nowhere to be found", "e", "%", "", "please the", "x_y x_y"]


def test_search_equals_the_scan(store):
    index, r = Index(store), random.Random(4)
    said = [x["text"].lower() for x in store.table("message").collect()]
    phrases = []
    for _ in range(8):
        text = r.choice(said)
        at = r.randrange(max(1, len(text) - 12))
        phrases.append(text[at : at + r.randint(3, 12)])
    for query in [*QUERIES, *phrases]:
        for limit in (3, 100):
            assert index.search(query, limit).collect() == scanned(store, query, limit).collect(), query
    packed, n = index.pack("ana", 60)
    assert n > len(packed.collect()) > 0


def test_only_the_buckets_of_the_query_are_read(store):
    index = Index(store)
    assert index.status()["fresh"] is False and index.status()["index_rows"] == 0
    assert sorted(index.refresh()) == sorted(index._parts()) and index.refresh() == []
    found = index.status()
    assert found["fresh"] and found["index_rows"] == found["message_rows"] > 0
    grams = list(postings.covering("banana"))
    assert grams == ["ban", "ana"]
    read = {f.split("bucket=")[1].split("/")[0] for f in index.read(grams).inputFiles()}
    every = {d for n in index.stats() for d in os.listdir(f"{index.path}/src={n}") if d.startswith("bucket=")}
    assert 1 <= len(read) <= 2 < len(every) <= BUCKETS
    plan = index.read(grams)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(gram" in plan.replace(" ", "")


def test_only_touched_parts_are_indexed_again(store, tmp_path):
    index = Index(store)
    index.refresh()
    before = set(index.stats())
    write(f"{tmp_path}/logs/s3.jsonl", 99, n=9)
    store.ingest([(SOURCES[0], f"{tmp_path}/logs")])
    assert len(index.stale()) == 1
    assert index.search("anana", 50).collect() == scanned(store, "anana", 50).collect()
    after = set(index.stats())
    assert len(before & after) == len(before) - 1 and index._names() == after and index.status()["fresh"]


def test_a_half_written_index_does_not_count(store):
    index = Index(store)
    index.refresh()
    name = sorted(index.stats())[0]
    os.remove(f"{index.path}/src={name}/STATS")
    assert index.stale() == [name] and index.refresh() == [name]
    assert index.search("ana", 100).collect() == scanned(store, "ana", 100).collect()


def test_phrase_counts(spark):
    r = random.Random(2)
    rows = [(k, "".join(r.choice("abA") for _ in range(r.randint(0, 40)))) for k in range(60)] + [(100, None), (101, ""), (102, "ab")]
    df = spark.createDataFrame(rows, "id int, text string")
    for phrase in ("aba", "abab", "aaaaa", "bbbabab", "ABAABAAB"):
        plain = {i: n for i, t in rows if (n := sum((t or "").lower().startswith(phrase.lower(), p) for p in range(len(t or ""))))}
        assert {x["id"]: x["f"] for x in postings.phrase_hits(df, ["id"], phrase).collect()} == plain
