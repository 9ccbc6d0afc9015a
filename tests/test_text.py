"""Scalars and predicates against stated values."""

import datetime

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as tx

HOME = "/home/me"


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (tx.unwrap, {"## My request:  do it": "do it", "x My request for Codex: y": "y", " [Image #1] [Image b] hi ": "hi", "": "", "see [Image #2] now": "see [Image #2] now"}),
    (tx.is_injected, {"": True, None: True, "  Caveat: no": True, "x" * 201 + "Caveat:": False, "caveat: no": False}),
    (tx.is_real_prompt, {"ab": False, "abc": True, "/status": False, "<x> y": False, "API Error 500": False, None: False}),
    (tx.is_task_prompt, {"alpha beta": False, "alpha beta gamma": True, "alpha alpha alpha": False, "帮我看看这个页面的布局问题吧": True, "中 abcdefghij": True, "the and for you": False}),
    (tx.signature, {"alpha beta alpha gamma": "alpha beta gamma", "中文 中文 测试": "", "b1b a1a b1b c1c d1d e1e f1f g1g": "a1a b1b c1c d1d e1e f1f"}),
    (
        lambda c: tx.project_root(c, HOME),
        {"/home/me/Projects/a/b": "~/Projects/a", '"/opt/x/y"': "/opt/x", "~": None, "": None, "/": None, "~/z/q": "~/z", "/x": "/x", "/srv/Downloads": "srv/Downloads", None: None},
    ),
    (tx.cd_targets, {"cd a && cd 'b c'; cd \"d e\"": ["a", "b c", "d e"], "ls": []}),
    (lambda c: tx.command_key(c, HOME), {"cd x && npm run build": "npm run", "cd x": None, "cd": None, "  git   commit -m x": "git commit", "": None}),
    (tx.install_pkgs, {"npm i react@18 @a/b@1 -D react": ["react", "@a/b"], "pip install 'uvicorn[standard]>=0.2' ./x $Y": ["uvicorn"], "uv add A && ls": ["a"], "ls": [], None: []}),
    (tx.manager, {"npm run": "npm", "PIP install": "pip", "mkdir x": None, None: None}),
    (tx.verification, {"pytest -q": "test", "git commit": "git", "tsc -p": "typecheck", "npm run": "build", "ls -l": None, "npm test": "test"}),
    (tx.libraries, {"use React and next, or NEXT.JS": ["react", "next.js"], "reactive": [], "用react吗": [], "use react.": [], "three d3": ["three.js", "d3"]}),
    (tx.file_ext, {"/a/b.PY": ".py", "/a/.bashrc": "", "x": "", "a.tar.gz": ".gz"}),
    (tx.clean_basename, {"/a/proj/": "proj", "<none>": None, "/a/x": None, "/a/.git": None, "/a/readme.md": None, "/home/Users": None}),
    (tx.token_cost, {"": 1, "abcdef": 2, "abcdefgh": 2}),
    (tx.length_class, {"x" * 39: "terse (<40)", "x" * 40: "normal (40-400)", "x" * 400: "normal (40-400)", "x" * 401: "detailed (>400)"}),
    (tx.has_acceptance, {"make sure it runs": True, "必须通过": True, "hi": False, "Don't": True, None: False}),
    (tx.wants_discussion, {"let's discuss": True, "先讨论一下": True, "hi": False}),
    (lambda c: tx.redact(c, HOME), {
        "sk-abcdefghij0123456789": "<KEY>", "Bearer abcdefghijk": "Bearer <KEY>", "a.b@c.de": "<EMAIL>", "token=abcdef": "token=<REDACTED>",
        "/home/me/x": "~/x", 'token = "abcdef1"': 'token = "abcdef1"', None: None,
    }),
    (lambda c: tx.redact(c, HOME, strict=True), {'token = "abcdef1"': "token=<REDACTED>"}),
    (lambda c: tx.parse_ts(c).cast("string"), {"2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T23:00:00-02:00": "2024-01-03 01:00:00", "2024": None, "x": None, "2024-01-02": "2024-01-02 00:00:00", "20240102": "2024-01-02 00:00:00", "20240102T030405Z": "2024-01-02 03:04:05", "2024-01-02T0304": "2024-01-02 03:04:00", "20240102T030405.5+0100": "2024-01-02 02:04:05.5", "202401": None}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalars(spark, case):
    f, expected = CASES[case]
    assert apply(spark, f, *expected) == list(expected.values())


def test_friction_bounds(spark):
    assert apply(spark, lambda c: tx.is_friction(c, F.lit(True)), "wrong " + "x" * 593, "wrong " + "x" * 594, "x" * 115 + "wrong", "x" * 116 + "wrong") == [True, False, True, False]
    assert apply(spark, lambda c: tx.is_friction(c, F.lit(False)), "wrong") == [False]


def test_timestamps_as_python_reads_them(spark):
    dates = ["2024-03-05", "20240305", "2024-W10-2", "2024W102", "2024-W10", "2024W10", "2024-03", "2024-3-5", "2024-13-01", "2024-02-30", "2024-W53-1", "2020-W53-7", "2024-366", "0001-01-01", "0000-01-01"]
    times = ["", "T10", "T10:15", "T1015", "T10:15:20", "T101520", "T10:15:20.5", "T101520.123456", "T10:15:20,123", "T10:15:20.1234567", " 10:15", "x10:15:20", "T24:00", "T10:60", "T1", "T10:1", "T10:15:", "T", "t10:15:20"]
    zones = ["", "Z", "+05:30", "-0530", "+05", "+05:30:15", "z", "+5", "+24:00", "-00:00", "+053015", "+05:3015"]
    rows = [d + t + z for d in dates for t in times for z in (zones if t else [""])] + ["", " 2024-03-05", "2024-03-05 ", "now", "2024-03-05T10:15:20ZZ"]

    def plain(text):
        try:
            found = datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        return (found if found.tzinfo else found.replace(tzinfo=datetime.UTC)) - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)

    df = spark.createDataFrame([(s,) for s in rows], "s string").select("s", F.unix_micros(tx.parse_ts(F.col("s"))).alias("at"))
    micro = datetime.timedelta(microseconds=1)
    assert {r["s"]: r["at"] for r in df.collect()} == {s: None if (t := plain(s)) is None else t // micro for s in rows}
    assert spark.range(1).select(tx.parse_ts(F.lit(None).cast("string")).alias("t")).first()["t"] is None
