"""A stored table that batches are merged into, a bucket at a time.

Rows are dealt to a fixed number of buckets by a hash of their keys. A version of the table is a manifest: one line for
each bucket that has rows, with the folder that holds them. A merge reads and writes only the buckets that the batch
touches, into a folder of its own, and then puts a new manifest beside the old ones by one rename; until then nothing has
changed, whatever was written, and readers of older versions are never disturbed. One writer at a time is assumed, as
in ``foreachBatch``.

Every value is kept with the ``seq`` that set it, so batches may come in any order, twice, or all at once, and the table
is the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomweave.runtime import drop_table, write_table

BUCKETS = 64
POLICIES = ("last", "first", "entries")
#: A bucket of so many times its share of a batch, and so many rows, is merged in part before it moves.
CROWDED, LEAST_ROWS = 4, 1 << 16
#: A task merges about so many rows; buckets with more are dealt to several tasks by key.
PER_TASK = 1 << 17


@dataclass
class Manifest:
    version: int
    keys: list[str]
    seq: str
    policy: str
    buckets: int
    schema: T.StructType
    folders: dict[int, str]


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    jvm, fs = _files(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(path, "manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a version; None for a table that isn't there yet. At most one line a bucket."""
    known = versions(spark, path)
    if not known:
        return None
    number = known[-1] if version is None else version
    jvm, fs = _files(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, f"manifest/{number}.json"))
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    head, *lines = text.splitlines()
    x = json.loads(head)
    return Manifest(number, x["keys"], x["seq"], x["policy"], x["buckets"], T.StructType.fromJson(x["schema"]), {b: f for b, f in map(json.loads, lines)})


def _put(spark: SparkSession, path: str, m: Manifest) -> None:
    head = {"keys": m.keys, "seq": m.seq, "policy": m.policy, "buckets": m.buckets, "schema": m.schema.jsonValue()}
    text = "\n".join(map(json.dumps, [head, *([b, f] for b, f in sorted(m.folders.items()))])) + "\n"
    jvm, fs = _files(spark, path)
    hadoop = jvm.org.apache.hadoop.fs
    draft, final = hadoop.Path(path, f"manifest/draft-{uuid.uuid4().hex}"), hadoop.Path(path, f"manifest/{m.version}.json")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {m.version} of {path} was written by another")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _merged(rows: DataFrame, keys: list[str], seq: str, policy: str) -> DataFrame:
    """One row a key. For ``entries`` map columns keep the value of each entry that was set last, as struct (v, seq)."""
    others = [c for c in rows.columns if c not in keys]
    maps = [f.name for f in rows.schema if f.name in others and isinstance(f.dataType, T.MapType)]
    if policy != "entries" or not maps:
        pick = F.min_by if policy == "first" else F.max_by
        # maps can't be compared, so rows of one key and seq are told apart by their text
        order = F.struct(seq, F.to_json(F.struct(*others)))
        return rows.groupBy(*keys).agg(pick(F.struct(*others), order).alias("x")).select(*keys, "x.*").select(*rows.columns)
    # a row falls into cells, itself without its maps and one for each entry, which are merged one by one: partial results are
    # small whatever a key's map holds, and grouping by the keys moves nothing where rows are dealt by one of them already
    plain = F.struct(*[c for c in others if c not in maps])
    kinds = [plain.alias("whole"), *[x for i, m in enumerate(maps) for x in (F.get(F.map_keys(m), F.lit(0)).alias(f"k{i}"), F.get(F.map_values(m), F.lit(0)).alias(f"e{i}"))]]
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in rows.select(*kinds).schema}
    cell = lambda m, **own: F.struct(F.lit(m).alias("m"), *[own.get(n, null).alias(n) for n, null in nulls.items()])
    of = lambda i: lambda x: cell(i, **{f"k{i}": x["key"], f"e{i}": x["value"]})
    entries = [F.transform(F.map_entries(m), of(i)) for i, m in enumerate(maps)]
    cells = rows.select(*keys, F.inline(F.concat(F.array(cell(-1, whole=plain)), *[F.coalesce(e, F.array().cast(rows.select(e).schema[0].dataType)) for e in entries])))
    chosen = [F.max_by("whole", F.struct(f"whole.{seq}", F.to_json("whole"))).alias("whole"), *[F.max_by(f"e{i}", F.struct(f"e{i}.seq", f"e{i}.v")).alias(f"e{i}") for i in range(len(maps))]]
    one = cells.groupBy(*keys, "m", *[f"k{i}" for i in range(len(maps))]).agg(*chosen)
    together = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("m") == i, F.struct(f"k{i}", f"e{i}"))))).alias(m) for i, m in enumerate(maps)]
    return one.groupBy(*keys).agg(F.first("whole", ignorenulls=True).alias("whole"), *together).select(*keys, "whole.*", *maps).select(*rows.columns)


def _with_seq(rows: DataFrame, seq: str, policy: str) -> DataFrame:
    if policy != "entries":
        return rows
    made = {f.name: F.transform_values(F.coalesce(f.name, F.create_map().cast(f.dataType)), lambda k, v: F.struct(v.alias("v"), F.col(seq).alias("seq"))) for f in rows.schema if isinstance(f.dataType, T.MapType)}
    return rows.withColumns(made)


def _without_seq(rows: DataFrame, policy: str) -> DataFrame:
    if policy != "entries":
        return rows
    return rows.withColumns({f.name: F.transform_values(f.name, lambda k, e: e["v"]) for f in rows.schema if isinstance(f.dataType, T.MapType)})


def merge(
    batch: DataFrame, path: str, keys: list[str], seq: str = "seq", policy: str = "last", buckets: int = BUCKETS,
    within: Callable[[DataFrame, list[str]], DataFrame] | None = None, after: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Merges ``batch`` into the table at ``path`` and returns its new version; an empty batch of a known table changes nothing.

    last, first: the whole row of the largest or smallest ``seq`` of a key; entries: likewise last, but map columns keep, for each
    entry, the value set last (a null map has none). Null keys are keys. Rows of one key and seq: the one that is greatest (first:
    least) as text. The table keeps the columns, keys, policy and number of buckets of its first batch.

    ``within``: makes the rows to merge from those of ``batch`` where all rows of a key already are, given the columns that these have in common
    beside the keys, which it has to group by and keep. Such a batch is not written first but computed twice, once for its keys alone, so it must give
    the same rows again. ``after``: adds to merged rows what is not compared (columns that are there as null), before they are written.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    spark = batch.sparkSession
    old = manifest(spark, path)
    if old is not None:
        keys, seq, policy, buckets = old.keys, old.seq, old.policy, old.buckets
    placed = batch.withColumn("_bucket", bucket_of(keys, buckets))
    schema = old.schema if old else (placed if within is None else within(placed, ["_bucket"])).drop("_bucket").schema
    own = lambda rows: _with_seq(rows.select("_bucket", *schema.names), seq, policy)
    staged, paths = placed, []
    if within is None:
        staged, temporary = write_table(own(placed), "merge", compression="zstd")
        paths.append(temporary)
    sizes = {r[0]: r[1] for r in staged.groupBy("_bucket").count().collect()}  # at most ``buckets`` numbers
    touched = sorted(sizes)
    number = old.version + 1 if old else 0
    folders = dict(old.folders) if old else {}
    if touched or old is None:
        # tasks to a bucket
        shares = max(1, -(-sum(sizes.values()) // (PER_TASK * max(1, len(touched)))))
        by = ["_bucket", "_share"]
        share = lambda rows: rows.withColumn("_share", F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(shares)).cast("int"))
        deal = lambda rows: rows.repartition(max(1, len(touched)) * shares, *by)
        rows, lie = share(staged), False
        if max(sizes.values(), default=0) > max(CROWDED * sum(sizes.values()) / buckets, LEAST_ROWS):
            # a key with many rows: these are merged where they are first, in part
            if within is not None:
                rows = share(own(within(staged, ["_bucket"])))
            rows, again = write_table(_merged(rows, [*by, *keys], seq, policy), "merge", compression="zstd")
            paths.append(again)
        elif within is not None:
            # dealt before its rows are made, which needs no other shuffle
            rows, lie = _with_seq(within(deal(rows), by).select(*by, *schema.names), seq, policy), True
        before = [f"{path}/{folders[b]}" for b in touched if b in folders]
        if before:
            stored = spark.read.schema(rows.drop(*by).schema).parquet(*before)
            rows, lie = rows.unionByName(share(stored.withColumn("_bucket", bucket_of(keys, buckets)))), False
        data = f"data/{uuid.uuid4().hex}"
        # dealt by bucket once; all that follows happens within the buckets
        merged = _merged(rows if lie else deal(rows), [*by, *keys], seq, policy).drop("_share").withColumnRenamed("_bucket", "bucket")
        merged = merged.sortWithinPartitions("bucket", *keys)
        (merged if after is None else after(merged)).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{data}")
        folders |= {b: f"{data}/bucket={b}" for b in touched}
        _put(spark, path, Manifest(number, keys, seq, policy, buckets, schema, folders))
    for done in paths:
        drop_table(spark, done)
    return number if touched or old is None else old.version


def _stored(m: Manifest) -> T.StructType:
    """The schema of the files: map entries with the seq that set them."""
    if m.policy != "entries":
        return m.schema
    kind = m.schema[m.seq].dataType
    wide = lambda t: T.MapType(t.keyType, T.StructType([T.StructField("v", t.valueType), T.StructField("seq", kind)])) if isinstance(t, T.MapType) else t
    return T.StructType([T.StructField(f.name, wide(f.dataType)) for f in m.schema])


def read(spark: SparkSession, path: str, version: int | None = None, only: list[tuple] | None = None) -> DataFrame | None:
    """The table, newest or of a version; None if it isn't there. ``only``: the rows of these keys, from their buckets alone."""
    m = manifest(spark, path, version)
    if m is None:
        return None
    folders, wanted = m.folders, None
    if only is not None:
        wanted = spark.createDataFrame(only, T.StructType([m.schema[k] for k in m.keys])).distinct()
        hit = {r[0] for r in wanted.select(bucket_of(m.keys, m.buckets)).distinct().collect()}
        folders = {b: f for b, f in folders.items() if b in hit}
    reader = spark.read.schema(_stored(m))
    rows = reader.parquet(*[f"{path}/{f}" for f in folders.values()]) if folders else spark.createDataFrame([], _stored(m))
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted), m.keys, "left_semi")  # as many rows as were asked for by hand
        if len(only) == 1:
            rows = rows.where(" and ".join(f"`{k}` <=> {_literal(v)}" for k, v in zip(m.keys, only[0], strict=True)))
    return _without_seq(rows, m.policy)


def _literal(value: object) -> str:
    if value is None:
        return "null"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all versions but the newest ``keep``, and folders that no version names; returns how many folders went."""
    jvm, fs = _files(spark, path)
    hadoop = jvm.org.apache.hadoop.fs
    known = versions(spark, path)
    for v in known[: -keep or None]:
        fs.delete(hadoop.Path(path, f"manifest/{v}.json"), False)
    named = {f for v in known[-keep:] for f in manifest(spark, path, v).folders.values()}
    gone = 0
    data = hadoop.Path(path, "data")
    for folder in fs.listStatus(data) if fs.exists(data) else []:
        name = folder.getPath().getName()
        parts = [s.getPath().getName() for s in fs.listStatus(folder.getPath()) if s.isDirectory()]
        own = [p for p in parts if f"data/{name}/{p}" not in named]
        for p in own:
            fs.delete(hadoop.Path(folder.getPath(), p), True)
        if len(own) == len(parts):
            fs.delete(folder.getPath(), True)
        gone += len(own)
    return gone
