"""Operator 5: shards by extendible hashing.

Documents are hashed to a path of bits. The directory is indexed by a prefix of the path; a bucket over the
byte limit, and no other, is split on its next bit until every bucket fits. The bytes of the prefixes are
counted once, level by level from the longest prefix down to the root, so the corpus is read twice (count
and assign) however deep the directory gets. Bits beyond the first 40 come from a row's place in the input:
rows of one doc_id can be split as well. A single row over the limit has a bucket of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.runtime import write_table

PATH_BITS, KEY_BITS = 60, 40
STEP = 10
LIMIT = 64 << 20
#: Of the registered query: small shards, so that small tables are split as well.
QUERY_LIMIT = 1 << 20


def path(doc_id: str = "doc_id") -> Column:
    """60 bits: 40 of the MD5 of doc_id as text (null: of an empty text), then 20 of that of the row's place."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    place = F.conv(F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, (PATH_BITS - KEY_BITS) // 4), 16, 10).cast("bigint")
    return F.shiftleft(key, PATH_BITS - KEY_BITS).bitwiseOR(place)


def _prefix(depth: int) -> Column:
    return F.shiftright("path", PATH_BITS - depth)


def directory(items: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, shard_bytes, shard_docs of every bucket for ``items`` (path, n_bytes)."""
    leaves, open_, base = None, items, 0
    total = items.agg(F.sum("n_bytes")).first()[0] or 0
    while base < PATH_BITS:
        # enough levels for even shares and some more; what is still too large then is looked at again, deeper
        step = min(PATH_BITS - base, max(STEP, (2 * total // limit).bit_length() + 3 if base == 0 else STEP))
        level = open_.groupBy(_prefix(base + step).alias("prefix")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        level, _ = write_table(level, "prefixes")
        found = None
        for depth in range(base + step, base - 1, -1):
            up = F.shiftright("prefix", base + step - depth)
            at = level.groupBy(up.alias("prefix")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")).select(F.lit(depth).alias("depth"), "prefix", "b", "n")
            found = at if found is None else found.union(at)
        # a bucket is one that fits (or can't be split) and whose parent doesn't fit
        fits = (F.col("b") <= limit) | (F.col("n") == 1) | (F.col("depth") == PATH_BITS)
        nodes, _ = write_table(found, "nodes")
        parents = nodes.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        good = nodes.where(fits).withColumn("up", F.shiftright("prefix", 1))
        top = good.where(F.col("depth") == base) if base == 0 else None
        own = good.where(F.col("depth") > base).join(parents, ["depth", "up"], "left_semi")
        own = (own.unionByName(top) if top is not None else own).select("depth", "prefix", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"))
        leaves = own if leaves is None else leaves.union(own)
        over = nodes.where((F.col("depth") == base + step) & ~fits).select(F.col("prefix").alias("over"))
        base += step
        if base >= PATH_BITS or over.isEmpty():
            break
        open_ = open_.join(over, _prefix(base) == F.col("over"), "left_semi")
    return leaves


def _sized() -> list[Column]:
    return [F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"), path().alias("path")]


def _placed(items: DataFrame, limit: int) -> DataFrame:
    """``items`` (path, n_bytes and more) with shard, depth, shard_bytes and shard_docs, each row once."""
    leaves, _ = write_table(directory(items.select("path", "n_bytes"), limit), "directory")
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most 61
    tried = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths] or [F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix"))])
    placed = items.select("*", F.inline(tried)).join(leaves, ["depth", "prefix"])
    return placed.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')")))


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, shard_docs for every row of ``docs`` (doc_id, text).

    n_bytes: bytes of the text as UTF-8 (null: 0). shard: the bits of the bucket's prefix ("" for a single
    bucket). Every shard holds at most ``limit`` bytes, or one row. Repeated rows are placed one by one; other
    columns are ignored; an empty table gives no shards.
    """
    items, _ = write_table(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_sized()), "items")
    return _placed(items, limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Writes each row of ``docs`` once, with all its columns, under ``folder``: one directory ``shard=s<bits>`` for each shard.

    Rows are placed themselves, not by doc_id, so repeated rows and null ids are all kept. A column of ``docs``
    named shard goes by the name shard_ within the files. An empty table writes none.
    """
    rows, _ = write_table(docs.select(F.struct("*").alias("row"), *_sized()), "rows")
    out = _placed(rows, limit)
    taken = next(c for c in ("shard", "shard_", "shard__") if c.lower() not in {x.lower() for x in docs.columns})
    own = [F.col("row")[c].alias(taken if c.lower() == "shard" else c) for c in docs.columns]
    out.select(*own, F.concat(F.lit("s"), F.col("shard")).alias("shard")).repartition("shard").write.partitionBy("shard").parquet(folder)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_LIMIT)


def oracle(limit: int = QUERY_LIMIT) -> str:
    """DuckDB SQL for the rows of :func:`shard` over ``documents``, for unique doc_id."""
    return f"""
with recursive items as (
  select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 10) as bigint) as path from documents),
nodes as (select d as depth, path >> cast({KEY_BITS} - d as integer) as prefix, cast(sum(n_bytes) as bigint) as b, count(*) as n from items, range({KEY_BITS // 2}) t(d) group by 1, 2),
leaves as (
  select a.depth, a.prefix, a.b, a.n from nodes a left join nodes p on p.depth = a.depth - 1 and p.prefix = a.prefix >> 1
  where (a.b <= {limit} or a.n = 1) and (a.depth = 0 or p.b > {limit} and p.n > 1))
select doc_id, n_bytes, case when depth = 0 then '' else right(repeat('0', 64) || bin(prefix), cast(depth as integer)) end as shard,
  cast(depth as integer) as depth, l.b as shard_bytes, l.n as shard_docs
from items join leaves l on l.prefix = path >> cast({KEY_BITS} - l.depth as integer)
"""
