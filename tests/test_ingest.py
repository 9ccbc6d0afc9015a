"""Log files of both sources through sessions, store, documents and commands."""

import json
import os

import pytest

from logloom import cli
from logloom.operators import digest, habits, report
from logloom.plans.store import Store, StoreEmpty
from logloom.sources.registry import SOURCES

A, B = SOURCES


def write(path, *records):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records)


def user(text, **more):
    return {"type": "user", "message": {"content": text}, **more}


def assistant(*blocks, tokens=5, model="m-1"):
    return {"type": "assistant", "message": {"model": model, "usage": {"output_tokens": tokens}, "content": list(blocks)}}


def tool(name, **given):
    return {"type": "tool_use", "name": name, "input": given}


@pytest.fixture
def roots(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(
        f"{a}/p/s1.jsonl",
        "",
        "{bad",
        [1],
        user("please build a parser module quickly", cwd="/home/me/Projects/web/src", timestamp="2024-01-01T10:00:00Z"),
        assistant(tool("Bash", command="cd x && npm i react@18"), tool("Edit", file_path="/home/me/Projects/web/a.TS"), tokens=7),
        {"type": "system"},
        user([{"type": "text", "text": "no, that's not"}, {"type": "image"}, {"type": "text", "text": "what i meant here"}], timestamp="2024-01-01T11:00:00Z"),
        assistant(tool("Bash", command="pytest -q")),
        user([{"type": "tool_result", "content": "ok"}]),
        user("revert everything about layout please", timestamp="2024-01-02T09:00:00Z"),
    )
    write(f"{a}/p/agent-x.jsonl", user("delegated research about parsing libraries"), assistant(tokens=1))
    write(f"{a}/p/none.jsonl", {"type": "summary"})
    write(f"{a}/p/tui.jsonl", user("status"), assistant())
    event = lambda **p: {"type": "event_msg", "timestamp": "2024-01-03T00:30:00Z", "payload": p}
    count = lambda n: event(type="token_count", info={"total_token_usage": {"output_tokens": n, "reasoning_output_tokens": 0}})
    write(
        f"{b}/r1.jsonl",
        {"type": "session_meta", "payload": {"id": "abc", "cwd": "~", "originator": "term"}},
        {"type": "turn_context", "payload": {"cwd": "~", "model": "g-5"}},
        event(type="user_message", message="## My request for Codex:\n必须把这个页面的布局改好看一点"),
        count(10),
        event(type="agent_message"),
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["git", "commit"], "workdir": "/srv/q/r"})}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{"}},
        count(25),
        count(25),
        event(type="token_count", info=None),
        count(40),
    )
    return a, b


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_ingest(spark, tmp_path, roots):
    a, b = roots
    st = Store(spark, str(tmp_path / "store"))
    with pytest.raises(StoreEmpty):
        st.guard()
    given = [(A, a), (B, b)]
    first = {(r["source"], r["status"]): r["n"] for r in st.ingest(given, home="/home/me").collect()}
    assert first == {("claude-code", "ingested"): 3, ("claude-code", "empty"): 1, ("codex", "ingested"): 1}
    t = st.tables()
    assert rows(t.session, "id", "kind", "project", "n_user", "n_asst", "out_tokens", "model") == [
        ("cc:agent-x", "meta", "<none>", 1, 1, 1, "m-1"),
        ("cc:s1", "real", "~/Projects/web", 3, 2, 12, "m-1"),
        ("cc:tui", "artifact", "<none>", 1, 1, 5, "m-1"),
        ("cx:abc", "real", "/srv/q", 1, 1, 40, "g-5"),
    ]
    # the tool result between assistant and user ends the assistant's turn
    assert rows(t.message.filter("session_id = 'cc:s1'"), "seq", "is_task", "is_friction") == [(1, True, False), (3, True, True), (5, True, False)]
    assert rows(t.tool_call, "session_id", "after_seq", "tool", "cmd_key", "file_ext", "pkgs") == [
        ("cc:s1", 2, "Bash", "npm i", None, ["react"]),
        ("cc:s1", 2, "Edit", None, ".ts", None),
        ("cc:s1", 4, "Bash", "pytest -q", None, None),
        ("cx:abc", 2, "codex:shell", "git commit", None, None),
        ("cx:abc", 2, "codex:shell", None, None, None),
    ]
    again = {(r["source"], r["status"]): r["n"] for r in st.ingest(given, home="/home/me").collect()}
    assert again == {("claude-code", "skipped"): 4, ("codex", "skipped"): 1}
    os.utime(f"{b}/r1.jsonl", (1, 1))
    write(f"{a}/p/tui.jsonl", user("describe another larger project thoroughly"), assistant())
    third = {(r["source"], r["status"]): r["n"] for r in st.ingest(given, home="/home/me").collect()}
    assert third == {("claude-code", "skipped"): 3, ("claude-code", "ingested"): 1, ("codex", "unchanged"): 1}
    assert rows(st.table("session").filter("id = 'cc:tui'"), "kind") == [("real",)]
    assert st.table("message").filter("session_id = 'cc:tui'").count() == 1
    assert st.table("session").count() == 4
    assert st.health()["status"] == "healthy"


def test_emptied_file_and_two_files_of_one_session(spark, tmp_path):
    a = str(tmp_path / "a")
    write(f"{a}/p/one.jsonl", user("write the first module of a larger system", timestamp="2024-01-01T10:00:00Z"), assistant())
    write(f"{a}/q/two.jsonl", user("write another module for the same system"), assistant())
    st = Store(spark, str(tmp_path / "store"))
    st.ingest([(A, a)])
    assert rows(st.table("session"), "id") == [("cc:one",), ("cc:two",)]
    # a changed file without a session takes its old one along
    write(f"{a}/p/one.jsonl", {"type": "summary"})
    counts = {r["status"]: r["n"] for r in st.ingest([(A, a)]).collect()}
    assert counts == {"empty": 1, "skipped": 1}
    assert rows(st.table("session"), "id") == rows(st.table("message"), "session_id") == [("cc:two",)]
    # of two files with one session id the last one's rows stay, and no others
    write(f"{a}/p/two.jsonl", user("this earlier file names the same session"), assistant(tool("Bash", command="git log")))
    write(f"{a}/q/two.jsonl", user("write another module for the same system"), assistant(tool("Bash", command="git diff")), user("and then describe all of it"))
    st.ingest([(A, a)])
    assert rows(st.table("session"), "id", "n_user") == [("cc:two", 2)]
    assert rows(st.table("message"), "session_id", "text") == [("cc:two", "and then describe all of it"), ("cc:two", "write another module for the same system")]
    assert rows(st.table("tool_call"), "cmd_key") == [("git diff",)]
    assert rows(st.table("manifest").filter("session_id is not null"), "session_id") == [("cc:two",), ("cc:two",)]
    assert st.health()["status"] == "healthy"


def test_a_failed_ingest_leaves_the_store(spark, tmp_path, roots, monkeypatch):
    a, _ = roots
    st = Store(spark, str(tmp_path / "store"))
    st.ingest([(A, a)], home="/home/me")
    before = rows(st.table("message"), "session_id", "seq", "text")
    write(f"{a}/p/tui.jsonl", user("describe another larger project thoroughly"), assistant())
    real = Store._write_text

    def broken(self, name, value):
        if name.startswith("POINTER"):
            raise OSError("lost")
        real(self, name, value)

    monkeypatch.setattr(Store, "_write_text", broken)
    with pytest.raises(OSError):
        st.ingest([(A, a)], home="/home/me")
    monkeypatch.undo()
    assert rows(st.table("message"), "session_id", "seq", "text") == before
    st.ingest([(A, a)], home="/home/me")
    places = st._places()["message"]
    write(f"{a}/p/tui.jsonl", user("describe a third larger project thoroughly"), assistant())
    st.ingest([(A, a)], home="/home/me")
    changed = {k for k, f in st._places()["message"].items() if places.get(k) != f}
    assert len(changed) == 1 and len(st._pointers()) == 2  # only the touched part is written


def test_an_unreadable_file_does_not_stop_others(spark, tmp_path, roots, monkeypatch):
    from logloom.sources import jsonl

    a, _ = roots
    st, found = Store(spark, str(tmp_path / "store")), jsonl.hashes
    monkeypatch.setattr(jsonl, "hashes", lambda *a, **k: found(*a, **k).filter("file_path not like '%s1.jsonl'"))
    counts = {r["status"]: r["n"] for r in st.ingest([(A, a)], home="/home/me").collect()}
    assert counts == {"ingested": 2, "empty": 1, "error": 1}
    monkeypatch.undo()
    assert {r["status"]: r["n"] for r in st.ingest([(A, a)], home="/home/me").collect()} == {"skipped": 3, "ingested": 1}


def test_documents(spark, tmp_path, roots):
    a, b = roots
    st = Store(spark, str(tmp_path / "store"))
    st.ingest([(A, a), (B, b)], home="/home/me")
    d, p = digest.build(st.tables()), habits.build(st.tables())
    assert set(d) == {"meta", "temporal", "projects", "tools_used", "commands_top", "edited_filetypes", "models", "output_tokens_est", "friction_candidates", "task_prompts", "per_source"}
    assert len(d["temporal"]["by_hour"]) == 24 and len(d["temporal"]["by_weekday"]) == 7
    assert d["meta"]["sessions"] == 2 and d["meta"]["span"] == ["2024-01-01", "2024-01-03"]
    assert d["output_tokens_est"] == {"claude-code": 18, "codex": 40}
    assert [f["session"] for f in d["friction_candidates"]] == ["cc:s1"]
    assert p["verification_habits"] == {"buckets": {"test": 1, "git": 1}, "commits": 1, "edits": 1, "test_to_edit_ratio": 1.0}
    assert p["stack_fingerprint"]["packages_installed"] == [{"name": "react", "n": 1}]
    assert p["prompting_style"]["n_prompts"] == 4
    assert len(p["friction_themes"]) == 1 and p["friction_themes"][0]["n"] == 1


def test_commands(spark, tmp_path, roots, capsys):
    a, b = roots
    store = ["--store", str(tmp_path / "store")]
    assert cli.main([*store, "triage"]) == 3
    assert cli.main([*store, "ingest", "--root", f"claude-code={a}", "--root", f"codex={b}"]) == 0
    capsys.readouterr()
    for name in COMMANDS_:
        assert cli.main([*store, name]) == 0, name
        assert capsys.readouterr().out.strip()
    assert cli.main([*store, "stats"]) == 0
    assert json.loads(capsys.readouterr().out)["real"] == {"claude-code": 1, "codex": 1}
    assert cli.main([*store, "search", " parser "]) == 0
    assert [(h["session"], h["source"]) for h in json.loads(capsys.readouterr().out)["hits"]] == [("cc:s1", "claude-code")]
    # sessions of the kind artifact are never found
    assert cli.main([*store, "search", "status"]) == 0
    assert json.loads(capsys.readouterr().out)["hits"] == []
    assert cli.main([*store, "pack", "a ", "--max-tokens", "20"]) == 0
    packed = json.loads(capsys.readouterr().out)
    assert packed["truncated"] and packed["used_tokens_est"] <= 20
    # a short query takes the latest first
    assert [set(i) for i in packed["items"]] == [{"session", "source", "project", "excerpt"}] and packed["items"][0]["excerpt"].startswith("revert")
    found = Store(spark, store[1])
    page = found.kept("report.html")
    assert "<h2>Hours and days</h2>" in page and "<h2>Verification</h2>" in page and "revert everything" in page
    assert "## Verification" in found.kept("profile.md")
    given = str(tmp_path / "digest.json")
    assert cli.main([*store, "digest", "--out", given]) == 0 and os.path.exists(given)
    capsys.readouterr()
    nothing = ["--store", str(tmp_path / "nothing"), "export"]
    assert cli.main([*nothing, "--digest", str(tmp_path / "no.json")]) == 1
    assert cli.main([*nothing, "--digest", given]) == 0  # degrades to what the digest gives
    read = capsys.readouterr()
    assert "digest only" in read.err and set(json.loads(read.out)) == {"schema", "source", "terms", "facts", "topics"}
    assert cli.main([*store, "cluster", "--embeddings", "--threshold", "0"]) == 0
    clusters = json.loads(capsys.readouterr().out)
    assert clusters["threshold"] == 0 and clusters["clusters"][0]["size"] == clusters["n_tasks"] and sum(clusters["clusters"][0]["sources"].values()) == clusters["n_tasks"]


def test_report_sections():
    document = {
        "digest": {
            "meta": {"span": ["2024-01-01", None], "meta_sessions_skipped": {"a": 2}}, "temporal": {"by_hour": [0] * 9 + [4] + [1] * 14, "by_weekday": [1, 0, 3, 0, 0, 0, 0]}, "per_source": {"a": 1500, "b": 1},
            "output_tokens_est": {"a": 2_500_000}, "models": {"opus-1": 3, "other": 1}, "projects": [{"cwd": f"~/p{i}", "sessions": 1, "share": 0.125} for i in range(8)],
            "commands_top": [{"cmd": "git diff", "n": 4}, {"cmd": "<b>", "n": 1}], "edited_filetypes": {".py": 2},
            "friction_candidates": [{"quote": "太丑 " + "x" * 80, "source": "a", "session": "1"}, {"quote": "no", "source": "b", "session": "2"}],
        },
        "clusters": {"n_tasks": 9, "n_singletons": 4, "mode": "tfidf", "clusters": [{"size": 3, "representative": "write the very long parser", "top_terms": ["parser"]}, {"size": 2, "representative": "short", "top_terms": []}]},
        "profile": {
            "prompting_style": {"n_prompts": 3, "median_chars": 7, "length_mix": {"terse (<40)": 3, "normal (40-400)": 1}, "discuss_first_rate": 0.06}, "stack_fingerprint": {"packages_installed": [{"name": "react", "n": 2}]},
            "verification_habits": {"buckets": {"test": 1}, "commits": 1, "edits": 2, "test_to_edit_ratio": None}, "friction_themes": [{"theme": "T", "n": 2, "quotes": ["q"]}, {"theme": "U", "n": 1, "quotes": []}],
        },
        "insights": ["one"],
    }
    found = {s.title: s for s in report.sections(document)}
    assert dict(found["Overview"].figures) == {"Span": "2024-01-01 – ", "Own sessions": "1.5k", "Delegated sessions": "2", "Output tokens": "≈2.5M"}
    assert found["Hours and days"].figures == [("Peak hour", "9"), ("Peak day", "Wednesday")]
    assert found["Models"].figures[0] == ("Share of the top family", "75%")
    assert [b.shown for b in found["Projects"].bars["Sessions by project"]] == ["12%"] * 6 + ["25%"] and found["Projects"].bars["Sessions by project"][-1].label == "other (2)"
    assert [(b.label, b.width) for b in found["Commands and files"].bars["Commands"]] == [("git diff", 1.0), ("<b>", 0.25)]
    assert len(found["Corrections"].lines) == 2 and "…" in found["Corrections"].lines[0] and found["Insights"].lines == ["one"]
    assert found["Recurring tasks"].lines == ["3× write the very long parser (parser)"]
    assert found["Candidate rules"].lines == ["T (2): “q”", "Discuss first, then write (6% of prompts)"]
    page = report.page(document)
    assert "&lt;b&gt;" in page and "<h2>Insights</h2>" in page
    assert "- [ ] T (2): “q”" in report.markdown(document) and report.sections({}) == []


COMMANDS_ = ("stats", "triage", "doctor", "capabilities", "digest", "report", "profile", "cluster", "export")


def test_clusters_by_vectors(spark, tmp_path, roots):
    a, b = roots
    st = Store(spark, str(tmp_path / "store"))
    st.ingest([(A, a), (B, b)], home="/home/me")
    found = cli.cluster_document(st, None, lambda: lambda texts: [[1.0, 0.0] if "parser" in t or "revert" in t else [0.0, 1.0] for t in texts], "two")
    assert found["mode"] == "embeddings" and found["threshold"] == 0.82
    assert sorted(sorted(c["sources"].items()) for c in found["clusters"]) == [[("claude-code", 1), ("codex", 1)], [("claude-code", 2)]]
    assert cli.cluster_document(st, None, lambda: None)["mode"] == "tfidf"


def test_broken_parts_are_named(spark, tmp_path, roots, monkeypatch):
    a, b = roots
    st = Store(spark, str(tmp_path / "store"))
    st.ingest([(A, a), (B, b)], home="/home/me")
    assert st.integrity() == st.integrity(deep=True) == "ok"
    read = []
    real = Store._files
    monkeypatch.setattr(Store, "_files", lambda self, folder: read.append(folder) or real(self, folder))
    folders = [f for t in st._places().values() for f in t.values()]
    assert st.broken() == [] and sorted(read) == sorted(folders)  # stamps only: no part differs, so none is decoded
    # a part with a row of another value, though of the same number of rows
    folder = next(iter(st._places()["session"].values()))
    rows = st.spark.read.parquet(f"{st.path}/{folder}").collect()
    changed = spark.createDataFrame([r.asDict() | {"n_user": r["n_user"] + 1} for r in rows], st.table("session").schema)
    changed.coalesce(1).write.mode("overwrite").parquet(f"{st.path}/{folder}")
    assert st.broken() == [folder] and st.health()["status"] == "degraded" and folder in st.health()["integrity"]
    # a flipped byte
    other = next(iter(st._places()["message"].values()))
    file = next(f"{st.path}/{other}/{n}" for n in os.listdir(f"{st.path}/{other}") if n.startswith("part-"))
    data = bytearray(open(file, "rb").read())
    data[len(data) // 3] ^= 255
    with open(file, "wb") as f:
        f.write(data)
    assert st.broken() == sorted([folder, other])


def test_junk_clusters_stay_out_of_markdown():
    names = ["# heading of a file", "add ssh-ed25519 AAAA to the host", "Continue from where you left off", "short", "write the parser for long tables"]
    document = {"clusters": {"n_tasks": 9, "clusters": [{"size": 9 - k, "representative": n, "top_terms": []} for k, n in enumerate(names)]}}
    text = report.markdown(document)
    assert "- 6× short" in text and "ssh-ed25519" not in text and "heading" not in text and "Continue" not in text
    assert "5× write the parser for long tables" in text
    assert "short" not in [line.split(" ", 1)[1] for line in next(s for s in report.sections(document) if s.title == "Recurring tasks").lines]
