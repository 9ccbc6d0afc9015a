"""The data source gives the rows of the line scan, and a further format is one class."""

import json
import os
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_scans import logs, read  # noqa: F401

from logloom.operators import sessions
from logloom.sources import connector
from logloom.sources.blocks import stem


def test_same_rows_as_the_scan(spark, logs):  # noqa: F811
    expected = read(spark, logs)
    for size in ("1", str(1 << 26)):
        found = connector.read_format(spark, connector.LogSource, logs, partitionBytes=size)
        rows = {(r["file_path"].split("/")[-1], r["line_no"], json.dumps(json.loads(r["rec"]), sort_keys=True)) for r in found.select("file_path", "line_no", F.to_json("rec").alias("rec")).collect()}
        assert rows == expected and found.rdd.getNumPartitions() == (6 if size == "1" else 1)
    one = spark.read.format("logloom").option("path", f"{logs}/s1.jsonl").load()
    assert one.select("file_path").distinct().count() == 1 and spark.read.format("logloom").option("path", logs).option("pattern", "no*").load().count() == 0


# the workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ChatText(connector.LogSource):
    """Lines like ``user> text``."""

    pattern = "*.chat"

    @classmethod
    def name(cls):
        return "chat-text"

    @staticmethod
    def json_of(line):
        who, mark, text = line.partition("> ")
        return json.dumps({"who": who, "text": text}) if mark else None


def test_a_third_format(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "day.chat").write_text("user> please write the whole parser module\nnoise\nbot> done\nuser> no, that's not what i meant\n")
    lines = connector.read_format(spark, ChatText, str(tmp_path / "in"))
    none = F.lit(None).cast("string")
    calls = F.lit(None).cast("array<struct<tool: string, command: string, file: string, workdir: string>>")
    who = F.try_variant_get("rec", "$.who", "string")
    records = lines.select(
        "file_path", "line_no", stem().alias("stem"), F.when(who == "user", "user").when(who == "bot", "assistant").otherwise("other").alias("kind"), none.alias("ts"), F.try_variant_get("rec", "$.text", "string").alias("text"),
        none.alias("native_id"), none.alias("cwd"), none.alias("model"), none.alias("originator"), F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("cumulative"), calls.alias("calls"), F.lit(False).alias("delegated"),
    )
    t = sessions.build(records, "chat-text", "ct")
    assert [(r["id"], r["n_user"], r["n_asst"], r["kind"]) for r in t.session.collect()] == [("ct:day", 2, 1, "real")]
    assert sorted((r["seq"], r["is_friction"]) for r in t.message.collect()) == [(1, False), (3, True)]
