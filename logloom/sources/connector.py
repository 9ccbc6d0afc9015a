"""Log files as a Spark data source: spark.read.format("logloom").option("path", ...).load().

A format is a class that says how a file's lines become JSON texts; further
ones are subclasses with a name of their own, registered in the same way.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of files that one partition reads, files being whole.
PARTITION_BYTES = 64 << 20


def _system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


class LogPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class LogReader(DataSourceReader):
    def __init__(self, source: type[LogSource], options: dict[str, str]):
        self.source, self.options = source, options

    def partitions(self) -> list[LogPartition]:
        """Files below the path whose names match, packed by their sizes in the order of their paths."""
        from pyarrow import fs

        system, root = _system(self.options["path"])
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        pattern, most = self.options.get("pattern", self.source.pattern), int(self.options.get("partitionbytes", PARTITION_BYTES))
        packs: list[list[str]] = []
        held = 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), pattern)), key=lambda f: f.path):
            if not packs or held + f.size > most:
                packs.append([])
                held = 0
            packs[-1].append(f.path)
            held += f.size
        return [LogPartition(p) for p in packs] or [LogPartition([])]

    def read(self, partition: LogPartition) -> Iterator[tuple[str, int, str]]:
        import io

        system, _ = _system(self.options["path"])
        for path in partition.files:
            with system.open_input_stream(path) as f:
                lines = io.TextIOWrapper(io.BufferedReader(f, 1 << 20), encoding="utf-8", errors="ignore", newline=None)
                for n, line in enumerate(lines):
                    text = self.source.json_of(line.strip())
                    if text:
                        yield path, n, text


class LogSource(DataSource):
    """Files of JSON lines; blank lines and those that are no objects are skipped."""

    pattern = "*.jsonl"

    @classmethod
    def name(cls) -> str:
        return "logloom"

    @staticmethod
    def json_of(line: str) -> str | None:
        """The JSON object that a line stands for, as text, or None."""
        return line if line.startswith("{") else None

    def schema(self) -> str:
        return "file_path string, line_no long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(type(self), {k.lower(): v for k, v in self.options.items()})


def read_format(spark: SparkSession, source: type[LogSource], path: str, **options: str) -> DataFrame:
    """(file_path, line_no, rec) of a format, for a normaliser; lines that aren't JSON are skipped."""
    spark.dataSource.register(source)
    lines = spark.read.format(source.name()).option("path", path).options(**options).load()
    return lines.select("file_path", "line_no", F.try_parse_json("line").alias("rec")).filter("rec is not null")
