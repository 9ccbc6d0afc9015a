"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import Folder


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v), root being the smallest node that it reaches.

    Rows that link a node with itself or hold a null are ignored, and repeated
    links change nothing.  Each step is written to the shared folder, and the
    one before it deleted; the number of steps grows with the logarithm of the
    number of nodes.
    """
    folder = Folder(links.sparkSession)
    edges = folder.write(links.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct())
    known = None
    while True:
        before, edges = edges, folder.write(_small_star(_large_star(edges)).distinct())
        folder.drop(before)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == known:
            break
        known = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
