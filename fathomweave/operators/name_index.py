"""Indexes by name: bucketed tables for joins without a shuffle, and an inverted table of letter groups for suggestions.

The bucketed tables hold nodes by name and edges by either end, each bucket one sorted file, so a join of an end with the
nodes reads bucket beside bucket, and a look-up of one name reads one bucket. A bucket is one task, so an end that a large
share of all edges has is better joined by ``graph.resolve``, which may split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.runtime import shuffle_partitions

BUCKETS = 64
#: Parts of the table of letter groups and of keywords, by a hash of their first letter.
PARTS = 64


def _table(rows: DataFrame, name: str, by: str, folder: str, buckets: int) -> None:
    # dealt as the buckets are, so each bucket is one file
    rows.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by).option("path", f"{folder}/{name}").saveAsTable(name)


def write(nodes: DataFrame, edges: DataFrame, name: str, folder: str, buckets: int = BUCKETS) -> None:
    """Tables {name}_nodes (nodes by name), {name}_from and {name}_to (edges by source_name and target_name) under ``folder``."""
    _table(nodes, f"{name}_nodes", "name", folder, buckets)
    _table(edges, f"{name}_from", "source_name", folder, buckets)
    _table(edges, f"{name}_to", "target_name", folder, buckets)


def open_index(spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS) -> None:
    """Makes the tables known to another session."""
    for part, by in (("nodes", "name"), ("from", "source_name"), ("to", "target_name")):
        columns = spark.read.parquet(f"{folder}/{name}_{part}").schema.toDDL()
        spark.sql(f"create table if not exists {name}_{part} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{folder}/{name}_{part}'")


def ends(spark: SparkSession, name: str, side: str) -> DataFrame:
    """The edges of a side (from, to) with the nodes of that end's name, an edge for each; nothing is shuffled."""
    edges, by = spark.table(f"{name}_{side}"), {"from": "source_name", "to": "target_name"}[side]
    nodes = spark.table(f"{name}_nodes")
    own = nodes.select(F.col("name").alias(by), F.struct(*[c for c in nodes.columns if c != "name"]).alias("node"))
    return edges.join(own.hint("merge"), by)


def missing_ends(spark: SparkSession, name: str) -> DataFrame:
    """As ``graph.missing_ends``, without a shuffle."""
    nodes, out = spark.table(f"{name}_nodes").select("name"), None
    for side, by, said in (("from", "source_name", "source"), ("to", "target_name", "target")):
        edges = spark.table(f"{name}_{side}")
        left = edges.join(nodes.hint("merge"), edges[by] == nodes["name"], "left_anti").withColumn("missing", F.lit(said))
        out = left if out is None else out.unionByName(left)
    return out


def find(spark: SparkSession, name: str, wanted: str) -> DataFrame:
    """The nodes of a name: one bucket is read, and of its file the part that may hold it."""
    return spark.table(f"{name}_nodes").where(F.col("name") == wanted)


def around(spark: SparkSession, name: str, wanted: str) -> DataFrame:
    """The edges at either end of a name, each once, from one bucket of each table."""
    there = spark.table(f"{name}_to").where((F.col("target_name") == wanted) & (F.col("source_name") != wanted))
    return spark.table(f"{name}_from").where(F.col("source_name") == wanted).unionByName(there)


def _part(letter: str) -> Column:
    return F.pmod(F.xxhash64(F.substring(letter, 1, 1)), F.lit(PARTS)).cast("int")


def write_letters(nodes: DataFrame, folder: str) -> None:
    """The tables behind :func:`suggest` for ``nodes`` (name, keywords): up to three letters from each place of a name, and keywords, sorted."""
    spark = nodes.sparkSession
    names = nodes.select("name").where("name is not null").distinct()
    low = F.lower("name")
    grams = names.where("name <> ''").select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, i, F.lit(3)))).alias("place", "gram"))
    words = nodes.where("name is not null").select(F.explode("keywords").alias("gram"), "name").where("gram <> ''").distinct()
    for table, rows in (("grams", grams), ("keywords", words)):
        rows.withColumn("part", _part("gram")).repartitionByRange(shuffle_partitions(spark), "part", "gram", "name").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{table}")
    names.write.mode("overwrite").parquet(f"{folder}/names")


def holding(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(name): the names that hold ``query`` in any case; its groups of three letters must stand one after another."""
    q = query.lower()
    grams = spark.read.schema("name string, place int, gram string, part int").parquet(f"{folder}/grams")
    part = {x[0]: x[1] for x in spark.createDataFrame([(c,) for c in set(q)], "c string").select("c", _part("c")).collect()}
    if len(q) <= 3:
        return _prefixed(grams, part, q).select("name").distinct()
    wanted = [(i, q[i : i + 3]) for i in range(len(q) - 2)]
    found = None
    for i, g in wanted:
        own = grams.where((F.col("part") == part[g[0]]) & (F.col("gram") == g)).select("name", (F.col("place") - i).alias("start"), F.lit(i).alias("i"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("name", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("name").distinct()


def _prefixed(rows: DataFrame, part: dict[str, int], q: str) -> DataFrame:
    """Rows whose gram begins with ``q``, as a range that the files' statistics know."""
    after = q[:-1] + chr(ord(q[-1]) + 1) if ord(q[-1]) < 0x10FFFF else None
    out = rows.where((F.col("part") == part[q[0]]) & (F.col("gram") >= q))
    return (out.where(F.col("gram") < after) if after and not 0xD800 <= ord(after[-1]) <= 0xDFFF else out).where(F.col("gram").startswith(q))


def suggest(spark: SparkSession, folder: str, query: str, most: int = 10) -> DataFrame:
    """As ``graph.suggest``: distinct names that hold the query, or have a keyword that starts with it, sorted; only the parts of its letters are read."""
    q = query.lower()
    if not q:
        return spark.read.parquet(f"{folder}/names").orderBy("name").limit(most)
    part = {x[0]: x[1] for x in spark.createDataFrame([(q[0],)], "c string").select("c", _part("c")).collect()}
    words = spark.read.schema("gram string, name string, part int").parquet(f"{folder}/keywords")
    return holding(spark, folder, q).unionByName(_prefixed(words, part, q).select("name")).distinct().orderBy("name").limit(most)
