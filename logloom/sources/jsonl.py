"""Tolerant JSON-lines scan; the order of lines is kept, and large files are split."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most files that a scan is narrowed to by name, which opens no others; more are joined.
MOST_NAMED = 1000
#: Most blocks of files whose numbers of lines are broadcast.
MOST_BLOCKS = 100_000
#: Bytes that a file's digest reads at a time.
CHUNK = 1 << 20
#: White space around a line.
BLANKS = " \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def scan(spark: SparkSession, kind: str, *roots: str, pattern: str = "*.jsonl") -> DataFrame:
    """Files below the roots in one of Spark's formats; what can't be read is left out."""
    tolerant = spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return tolerant.load(list(roots)).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"))


def only(scanned: DataFrame, chosen: DataFrame | list[str] | None) -> DataFrame:
    """Rows of chosen files: by names, which the scan uses to open no others, or by a table with file_path."""
    if chosen is None:
        return scanned
    if isinstance(chosen, list):
        return scanned.filter(F.col("file_path").isin(*chosen))
    return scanned.join(chosen.select("file_path"), "file_path", "left_semi")


def numbered(spark: SparkSession, *roots: str, pattern: str = "*.jsonl", chosen: DataFrame | list[str] | None = None) -> DataFrame:
    """(file_path, line_no, value): every line, numbered from 0 within its file, though a file is read in many splits.

    A split's lines come in their order, so a line's place in its split is its
    row number less the first one's.  A first pass counts the lines of each
    split; the running sum of these counts over a file's splits, in the order
    of their offsets, is the number of each split's first line.
    """
    named = chosen if isinstance(chosen, list) else None
    rows = only(scan(spark, "text", *roots, pattern=pattern), named).select("file_path", "_block", F.monotonically_increasing_id().alias("_at"), "value")
    blocks = rows.groupBy("file_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    if not isinstance(chosen, list):
        blocks = only(blocks, chosen)
    before = F.sum("_n").over(Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = blocks.select("file_path", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")).persist()
    few = firsts.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS
    return rows.join(F.broadcast(firsts) if few else firsts, ["file_path", "_block"]).select("file_path", (F.col("_at") + F.col("_shift")).alias("line_no"), "value")


def read_lines(spark: SparkSession, *roots: str, pattern: str = "*.jsonl", chosen: DataFrame | list[str] | None = None) -> DataFrame:
    """(file_path, line_no, rec): every line below the roots that holds a JSON object, as a VARIANT.

    Blank lines, malformed ones and lines that aren't objects are skipped;
    bytes that aren't UTF-8 are dropped.  ``chosen`` narrows the files.
    """
    lines = numbered(spark, *roots, pattern=pattern, chosen=chosen)
    clean = F.btrim(F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")), F.lit(BLANKS))
    parsed = lines.select("file_path", "line_no", clean.alias("line")).filter(F.col("line").startswith("{"))
    return parsed.select("file_path", "line_no", F.try_parse_json("line").alias("rec")).filter("rec is not null")


def files(spark: SparkSession, *roots: str, pattern: str = "*.jsonl") -> DataFrame:
    """Listing (file_path, file_mtime, file_size) without reading the contents; Spark's scans list no files of 0 bytes."""
    found = scan(spark, "binaryFile", *roots, pattern=pattern)
    return found.select("file_path", F.col("modificationTime").alias("file_mtime"), F.col("length").alias("file_size"))


def hashes(spark: SparkSession, *roots: str, pattern: str = "*.jsonl", chosen: DataFrame | list[str] | None = None, large: int = 1 << 28, chunk: int = CHUNK, largest: int | None = None) -> DataFrame:
    """(file_path, content_hash): SHA-1 of files; those that can't be read are missing.

    Files up to ``large`` bytes are digested as one value.  A value can't hold
    larger ones: tasks read them in chunks.  ``largest``, if known, tells
    whether there are any.
    """
    held = only(scan(spark, "binaryFile", *roots, pattern=pattern).filter(F.col("length") <= large), chosen).select("file_path", F.sha1("content").alias("content_hash"))
    if largest is not None and largest <= large:
        return held
    rest = only(scan(spark, "binaryFile", *roots, pattern=pattern).filter(F.col("length") > large), chosen).select("file_path", "length")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        from urllib.parse import unquote

        from pyarrow import fs

        for batch in batches:
            names, found = batch.column(0).to_pylist(), []
            for name in names:
                local = name.startswith("file:")
                system, path = (fs.LocalFileSystem(), "/" + unquote(name[5:]).lstrip("/")) if local else fs.FileSystem.from_uri(name)
                digest = hashlib.sha1()
                try:
                    with system.open_input_stream(path) as f:
                        while part := f.read(chunk):
                            digest.update(part)
                    found.append(digest.hexdigest())
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["file_path", "content_hash"])

    # a file is a task's whole work, so each gets its own
    tasks = rest.repartition(max(1, min(rest.count(), 4096)), "file_path")
    return held.union(tasks.mapInArrow(digested, "file_path string, content_hash string").filter("content_hash is not null"))
