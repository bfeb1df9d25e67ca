"""Connected components of a distributed edge table by alternating star contractions.

No node's neighbours are gathered in one place: each round is two minimum aggregations with map-side
partial results and two joins that adaptive execution may split, so a hub with a third of all nodes is
no bottleneck. Rounds needed grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomweave.runtime import drop_table, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, written: list[str] | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: bigint); component is the smallest node reachable.

    Null ends and self-loops are ignored; repeated edges count once; no edges give no rows. The path of the
    table that the result reads is added to ``written``, for the caller to drop.
    """
    spark = edges.sparkSession
    start = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = write_table(start, "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen["n"] == 0 or mark == (seen["n"], seen["x"]):
            break
        mark = (seen["n"], seen["x"])
        # after a small star every u > v, so the large star sees each edge once per direction
        after, new_path = write_table(_small_star(_large_star(now)), "edges")
        drop_table(spark, path)
        now, path = after, new_path
    if written is not None:
        written.append(path)
    labelled = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labelled.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
