"""Commands over a store: data to stdout, progress to stderr.

Exit codes: 0 ok, 1 unhealthy, 3 empty, 5 corrupt, 6 other schema version.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logloom.operators import embedding, export, habits, report, similarity
from logloom.plans.index import Index
from logloom.plans.kept import Kept
from logloom.plans.store import CORRUPT, EMPTY, OK, SCHEMA_VERSION, UNHEALTHY, VERSION, Store, StoreCorrupt, StoreEmpty, StoreVersion
from logloom.sources.registry import SOURCES

PURPOSES = {
    "triage": "whether the store is ready, and what to run next",
    "ingest": "read the sources' changed files into the store",
    "stats": "sessions by source and kind",
    "digest": "counts, shares and exemplars; kept in the store",
    "cluster": "recurring tasks",
    "profile": "habits as Markdown, or as JSON with --json",
    "report": "one HTML page of digest, clusters and profile",
    "search": "prompts that hold a phrase, best first",
    "pack": "excerpts of hits within a token budget",
    "export": "vocabulary and facts from the digest and the profile",
    "doctor": "integrity, coverage, orphans, size",
    "capabilities": "this description",
}
COMMANDS = list(PURPOSES)
EXIT_CODES = {OK: "ok", UNHEALTHY: "unhealthy", EMPTY: "empty: run ingest", CORRUPT: "corrupt: run ingest --full", VERSION: "other schema version: run ingest --full"}
def say(message: str) -> None:
    print(message, file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom")
    p.add_argument("--store", default="loom-store")
    sub = p.add_subparsers(dest="command", required=True)
    for name, purpose in PURPOSES.items():
        c = sub.add_parser(name, help=purpose)
        c.add_argument("--json", action="store_true")
        c.add_argument("--pretty", action="store_true")
        c.add_argument("--out")
        if name == "ingest":
            c.add_argument("--full", action="store_true")
            c.add_argument("--root", action="append", default=[], help="SOURCE=FOLDER")
        if name in ("search", "pack"):
            c.add_argument("query")
            c.add_argument("--limit", type=int, default=20 if name == "search" else 200)
            c.add_argument("--max-tokens", type=int, default=4000)
        if name in ("cluster", "profile", "report"):
            c.add_argument("--embeddings", action="store_true")
        if name == "cluster":
            c.add_argument("--threshold", type=float)
        if name == "doctor":
            c.add_argument("--deep", action="store_true", help="read every part, not only those whose files changed")
        if name == "export":
            c.add_argument("--digest", help="a digest file instead of the store's")
            c.add_argument("--no-db", action="store_true", help="only what the digest gives")
    return p


def cluster_document(store: Store, threshold: float | None = None, embed: embedding.Loader | None = None, model: str = embedding.MODEL) -> dict[str, Any]:
    """Recurring tasks: at most similarity.LIMIT texts, by the vectors of a model where one is at hand, else by TF-IDF."""
    t = store.tables()
    real = t.session.filter("kind = 'real'").select(F.col("id").alias("session_id"), "source")
    tasks = t.message.join(real, "session_id").filter("is_task and text is not null")
    texts = tasks.select(F.concat_ws("#", "session_id", F.format_string("%08d", "seq")).alias("id"), "text", "source").orderBy("id").limit(similarity.LIMIT).persist()
    n = texts.count()
    if not n:
        return {"mode": "none", "n_tasks": 0, "clusters": []}
    vectors = embedding.embedded(texts, embed, model) if embed else None
    mode, usual, vec = ("embeddings", similarity.VECTOR_THRESHOLD, "vec") if vectors is not None else ("tfidf", similarity.TFIDF_THRESHOLD, None)
    cut = usual if threshold is None else threshold
    found = similarity.cluster_texts(texts if vectors is None else vectors.persist(), cut, vec=vec).persist()
    rows = similarity.summary(texts, found).collect()
    alone = similarity.singletons(texts, found).collect()
    single = found.groupBy("leader").count().filter("count = 1").count()
    return {
        "mode": mode, "threshold": cut, "n_tasks": n, "n_singletons": single,
        "clusters": [{"size": r["size"], "representative": r["representative"], "top_terms": r["top_terms"], "sources": r["sources"], "sample_sessions": [m.split("#")[0] for m in r["members"]]} for r in rows],
        "singleton_samples": [r["sample"] for r in alone],
    }


def clusters_for(store: Store, args: argparse.Namespace) -> dict[str, Any]:
    found = cluster_document(store, getattr(args, "threshold", None), embedding.fastembed() if args.embeddings else None)
    if args.embeddings and found["mode"] != "embeddings":
        say("no embedding model at hand: clustered by TF-IDF")
    say(f"mode {found['mode']}, {found['n_tasks']} tasks, {len(found['clusters'])} clusters")
    return found


def export_document(store: Store, args: argparse.Namespace) -> tuple[int, Any]:
    """The export of a digest file, or of the store's digest; with the profile unless it can't be had."""
    if args.digest:
        if not os.path.exists(args.digest):
            say(f"no digest at {args.digest}: run ingest and digest --out {args.digest} first")
            return UNHEALTHY, None
        with open(args.digest, encoding="utf-8") as f:
            found = json.load(f)
    else:
        kept = store.kept("digest.json")
        if kept is None:
            store.guard()
        found = json.loads(kept) if kept else Kept(store).digest()
    profile = None
    if not args.no_db:
        try:
            store.guard()
            profile = habits.build(store.tables())
        except (StoreEmpty, StoreVersion, StoreCorrupt, PySparkException) as e:
            say(f"no profile ({e}): only what the digest gives")
    out = export.build(store.spark, found, profile)
    say(f"terms {len(out['terms'])}, facts {len(out['facts'])}, topics {len(out['topics'])}" + ("" if profile else " (digest only)"))
    say("first terms: " + " · ".join(t["term"] for t in out["terms"][:20]))
    for f in out["facts"]:
        say(f"fact [{f['topic']}] {f['fact']}")
    return OK, out


def readiness(store: Store) -> tuple[int, dict[str, Any]]:
    found = store.version()
    if found not in (None, SCHEMA_VERSION):
        return VERSION, {"status": "schema-mismatch", "ready": False, "version": found, "expected": SCHEMA_VERSION, "next_command": "ingest --full"}
    counts = store.stats()
    if not counts["sessions_by_source_kind"]:
        return EMPTY, {"status": "empty", "ready": False, "next_command": "ingest"}
    return OK, {"status": "ok", "ready": True, **counts, "version": found, "last_ingest": store.last_ingest(), "next_command": "digest && cluster"}


def placed(store: Store, args: argparse.Namespace, name: str, text: str) -> str:
    """Writes a document to --out, or to its place in the store; returns where."""
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
        where, args.out = args.out, None
    else:
        where = store.keep(name, text)
    say(f"{len(text.encode()) / 1024:.1f} KB -> {where}")
    return where


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[int, Any]:
    store = Store(spark, args.store)
    name = args.command
    if name == "capabilities":
        return OK, {
            "version": SCHEMA_VERSION, "exit_codes": {str(k): v for k, v in EXIT_CODES.items()}, "discipline": "stdout: data only; stderr: progress and diagnostics",
            "commands": [{"cmd": c, "purpose": p, "json": True} for c, p in PURPOSES.items()], "typical_flow": ["triage", "ingest", "digest", "cluster"],
        }
    if name == "ingest":
        start, roots = time.time(), dict(r.split("=", 1) for r in args.root)
        chosen = [(s, roots.get(s.name, os.path.expanduser(s.root))) for s in SOURCES if not roots or s.name in roots]
        counts = store.ingest(chosen, args.full).collect()
        status = {f"{r['source']}:{r['status']}": r["n"] for r in counts}
        say(f"ingested in {time.time() - start:.2f} s: {status}")
        return OK, {"elapsed_s": round(time.time() - start, 2), "status": status, "sessions_by_source_kind": store.stats()["sessions_by_source_kind"]}
    if name == "triage":
        return readiness(store)
    if name == "doctor":
        found = store.health(args.deep) | {"digest_missing": store.kept("digest.json") is None}
        if found["integrity"] == "ok":
            found["index"] = Index(store).status()
        return OK if found["status"] == "healthy" else CORRUPT if found["integrity"] != "ok" else UNHEALTHY, found
    if name == "stats":
        return OK, store.stats()
    if name == "export":
        return export_document(store, args)
    store.guard()
    t = store.tables()
    if name == "digest":
        found = Kept(store).digest()
        say(f"digest -> {store.keep('digest.json', json.dumps(found, ensure_ascii=False, indent=2))}")
        return OK, found
    if name == "cluster":
        return OK, clusters_for(store, args)
    if name in ("profile", "report"):
        document = {"digest": Kept(store).digest(), "clusters": clusters_for(store, args), "profile": habits.build(t)}
        if name == "report":
            document["digest"]["meta"]["generated"] = time.strftime("%Y-%m-%dT%H:%M")
            return OK, placed(store, args, "report.html", report.page(document))
        if args.json:
            return OK, {"profile": document["profile"], "clusters": document["clusters"], "span": document["digest"]["meta"]["span"]}
        return OK, placed(store, args, "profile.md", report.markdown({k: document[k] for k in ("clusters", "profile")}, time.strftime("%Y-%m-%dT%H:%M")))
    if name == "search":
        hits = Index(store).search(args.query, args.limit)
        return OK, {"query": args.query, "hits": [r.asDict() for r in hits.collect()]}
    packed, n_hits = Index(store).pack(args.query, args.max_tokens, args.limit)
    items = packed.collect()
    return OK, {"query": args.query, "max_tokens": args.max_tokens, "used_tokens_est": items[-1]["used"] if items else 0, "truncated": len(items) < n_hits, "items": [{"session": r["session"], "source": r["source"], "project": r["project"], "excerpt": r["excerpt"]} for r in items]}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("logloom").config("spark.sql.session.timeZone", os.environ.get("TZ", "UTC")).getOrCreate()
    try:
        code, out = run(spark, args)
    except (StoreEmpty, StoreVersion, StoreCorrupt) as e:
        say(f"store not ready: {e}; {EXIT_CODES[e.code]}")
        return e.code
    if out is None:
        return code
    text = out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2 if args.pretty else None, default=str)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
        print(args.out)
    else:
        print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
