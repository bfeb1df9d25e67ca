"""Operator 2: token ids in a content-addressed store.

Format (three parquet tables under one folder):
  chunks/kind=0   key (BLAKE2b-128 of the chunk's ids as unsigned little-endian 32-bit), n, body; each key once.
                  body: one byte of id width (2 or 4), then the ids of that width, zstd-compressed.
  recipes         part, pos, doc_id, n, key, body: the documents in ascending doc_id order, equal ones by key (a hash
                  of body); body lists a key (16 bytes) for each chunk of the document and the number of the document's
                  ids up to the chunk's end (4 bytes, big-endian).
  manifest        level, ord, hash: a Merkle tree over the recipes in that order; the last level is the root.
Cuts lie where a gear hash rolling over 32 ids has its top bits zero, so equal passages give equal chunks
wherever they stand. A task writes a chunk it has seen once only, so a passage that a third of all
documents share reaches the shuffle once for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.llm.encode import ID_TYPE, default_tokenizer, shared_encoder
from fathomweave.runtime import drop_table, new_path, ship, shuffle_partitions, write_table

SHORTEST, LONGEST, CUT_BITS = 128, 4096, 9
GROUP = 1 << 20  # ids that are chunked in one vector operation
SEEN = 1_000_000
FAN_IN = 256
PER_RANGE = 100_000  # documents in a range of the recipes, about
FINE = 1 << 12
MANIFEST = "ord bigint, hash string"


def gear(ids: np.ndarray) -> np.ndarray:
    """At each id the rolling hash of the 32 ids that end there."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint32) + np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        for k in (1, 2, 4, 8, 16):
            later = h.copy()
            later[k:] += h[:-k] << np.uint32(k)
            h = later
    return h


def cut(candidates: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of ids[begin:end]; ``candidates``: sorted places after which a cut may lie."""
    ends, at = [], begin
    while end - at > SHORTEST:
        k = np.searchsorted(candidates, at + SHORTEST)
        to = min(int(candidates[k]) if k < len(candidates) else end, at + LONGEST, end)
        ends.append(to)
        at = to
    if at < end or begin == end:
        ends.append(end)
    return ends


def _encoded(path: str, end_id: int):
    import hashlib

    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack, seen = shared_encoder(path), zstandard.ZstdCompressor(level=1), set()
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        last = np.array([end_id], ID_TYPE).tobytes()

        def chunked(docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in docs), ID_TYPE)
            places = np.flatnonzero(gear(ids) >> np.uint32(32 - CUT_BITS) == 0) + 1
            narrow = ids.astype("<u2") if width == 2 else ids
            rows, at = [], 0
            for doc_id, raw in docs:
                begin, refs = at, []
                for to in cut(places, begin, begin + len(raw) // 4):
                    key = hashlib.blake2b(ids[at:to], digest_size=16).digest()
                    refs.append(key + (to - begin).to_bytes(4, "big"))
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        rows.append((0, key, None, to - at, bytes([width]) + pack.compress(narrow[at:to])))
                    at = to
                body = b"".join(refs)
                rows.append((1, hashlib.blake2b(body, digest_size=16).digest(), doc_id, len(raw) // 4, body))
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "key", "doc_id", "n", "body"])

        for batch in batches:
            docs, size = [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.stream(batch.column(1)), strict=True):
                docs.append((doc_id, ids + last))
                size += len(docs[-1][1]) // 4
                if size >= GROUP:
                    yield chunked(docs)
                    docs, size = [], 0
            if docs:
                yield chunked(docs)

    return run


def write_store(docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int = 0) -> str:
    """Writes the ids of every text of ``docs`` (doc_id, text; null text: none), each with ``end_id`` after it, under ``root``.

    Repeated rows are separate documents; rows of one doc_id, and of null, stand together (null first), in an
    order fixed by their content. An empty table gives an empty store. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded(tokenizer or default_tokenizer(), end_id), "kind int, key binary, doc_id bigint, n bigint, body binary")
    # only chunks are compared with one another; recipes of equal documents have one key and are spread at random
    rows = rows.withColumn("apart", F.when(F.col("kind") == 1, F.xxhash64(F.monotonically_increasing_id())))
    first = F.row_number().over(Window.partitionBy("key", "apart").orderBy("kind", "n"))
    # written as "or" so that no sort by key comes before the shuffle: repeats within a task are gone already
    rows.withColumn("at", first).where("at < 2 or kind = 1").drop("at", "apart").write.partitionBy("kind").parquet(f"{root}/chunks")
    loose = spark.read.schema("key binary, doc_id bigint, n bigint, body binary, kind int").parquet(f"{root}/chunks").where("kind = 1").drop("kind")
    # rows alike in doc_id and key are alike in all
    rows = loose.count()
    ranges = max(shuffle_partitions(spark), -(-rows // PER_RANGE))
    (
        loose.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "key")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
        .withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .write.parquet(f"{root}/recipes")
    )
    drop_table(spark, f"{root}/chunks/kind=1")

    def put(level: DataFrame, k: int) -> DataFrame:
        level.write.parquet(f"{root}/manifest/level={k}")
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/level={k}")

    root_of(put(leaves(placed(recipes(spark, root))), 0), rows, put)
    return root


def recipes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("key binary, doc_id bigint, n bigint, body binary, part int, pos bigint").parquet(f"{root}/recipes")


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """key, n and the verified facts of each stored chunk: crc of its ids. A chunk that isn't what its key says stops the job."""
    ship(spark)
    read = spark.read.schema("key binary, n bigint, body binary, kind int").parquet(f"{root}/chunks").where("kind = 0").select("key", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        unpack = unpacker()
        for batch in batches:
            ids = [opened(k.as_py(), b.as_py(), unpack) for k, b in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64())], names=["key", "n", "crc"])

    return read.mapInArrow(run, "key binary, n bigint, crc bigint")


def unpacker():
    import zstandard

    return zstandard.ZstdDecompressor()


def opened(key: bytes, body: bytes, unpack) -> bytes:
    """The ids of a stored chunk as little-endian unsigned 32-bit integers, held against its address; ``unpack``: an :func:`unpacker`."""
    import hashlib

    ids = np.frombuffer(unpack.decompress(memoryview(body)[1:]), f"<u{body[0]}").astype(ID_TYPE).tobytes()
    if hashlib.blake2b(ids, digest_size=16).digest() != key:
        raise ValueError(f"chunk {key.hex()} does not hold what its address says")
    return ids


def placed(read: DataFrame) -> DataFrame:
    """Adds ``start`` (ids of all documents before) and ``ord`` (number of documents before).

    Only one row for each part is summed up across parts; within a part the rows are in order already.
    """
    sums = read.groupBy("part").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sums = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = read.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("ord", F.count("*").over(inside))
    return own.join(sums, "part").withColumn("start", F.col("start") + F.col("ids_before")).withColumn("ord", F.col("ord") + F.col("docs_before")).drop("ids_before", "docs_before")


def leaves(ordered: DataFrame) -> DataFrame:
    """ord, hash of each recipe of ``ordered`` (ord, doc_id, n, body)."""
    text = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n").cast("string"), F.hex("body"))
    return ordered.select("ord", F.sha2(text.cast("binary"), 256).alias("hash"))


def _parents(level: DataFrame) -> DataFrame:
    # at most FAN_IN children are gathered for a node
    return level.groupBy(F.floor(F.col("ord") / FAN_IN).alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "hash"))).alias("of")).select("ord", F.sha2(F.array_join(F.col("of.hash"), "").cast("binary"), 256).alias("hash"))


def root_of(level: DataFrame, rows: int, put: Callable[[DataFrame, int], DataFrame]) -> str | None:
    """The root of the tree over ``level`` (ord, hash) of that many rows; ``put`` writes each level above and gives it back as it is read."""
    k = 0
    while rows > 1:
        rows, k = -(-rows // FAN_IN), k + 1
        level = put(_parents(level), k)
    return level.first()["hash"] if rows else None


def same_root(spark: SparkSession, root: str) -> bool:
    """True if the tree over the recipes, as they are read now, has the manifest's root."""
    paths = []

    def put(level: DataFrame, k: int) -> DataFrame:
        table, path = write_table(level, "merkle")
        paths.append(path)
        return table

    read = recipes(spark, root)
    now = root_of(leaves(placed(read)), read.count(), put)
    for path in paths:
        drop_table(spark, path)
    last = spark.read.schema(f"{MANIFEST}, level int").parquet(f"{root}/manifest").orderBy(F.col("level").desc()).first()
    return now == (last["hash"] if last else None)


def verify(spark: SparkSession, root: str) -> bool:
    """True if the tree over the recipes as they are read now has the manifest's root and every chunk is there and opens."""
    refs = references(spark, root)
    return same_root(spark, root) and refs.join(chunks(spark, root).withColumnRenamed("n", "has"), "key", "left").where("has is null or has <> n").isEmpty()


def references(spark: SparkSession, root: str) -> DataFrame:
    """part, pos, seq, key, n, after: the chunks of each document in order, their lengths and the number of the document's ids after them."""
    at = F.expr("explode(sequence(0, cast(length(body) / 20 as int) - 1))")
    split = recipes(spark, root).select("part", "pos", F.col("n").alias("whole"), "body", at.alias("seq"))
    ends = [F.expr(f"cast(conv(hex(substring(body, seq * 20 + {x}, 4)), 16, 10) as bigint)") for x in (17, -3)]
    return split.select("part", "pos", "seq", F.expr("substring(body, seq * 20 + 1, 16)").alias("key"), (ends[0] - F.when(F.col("seq") > 0, ends[1]).otherwise(0)).alias("n"), (F.col("whole") - ends[0]).alias("after"))


def _found(refs: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """``refs`` with ``columns`` of their chunks; a chunk that is missing or of another length stops the job."""
    met = refs.join(stored.withColumnRenamed("n", "has"), "key", "left")
    fault = F.raise_error(F.concat(F.lit("a chunk is missing or has another length: "), F.hex("key")))
    return met.withColumn("has", F.when(F.col("has") == F.col("n"), F.col("has")).otherwise(fault.cast("bigint"))).select(*refs.columns, "has", *columns)


def reconstruct(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, ids (array<int>): every document's ids, put together from the stored chunks."""
    ship(spark)
    read = spark.read.schema("key binary, n bigint, body binary, kind int").parquet(f"{root}/chunks").where("kind = 0").select("key", "n", F.col("body").alias("chunk"))
    whole = _found(references(spark, root), read, ["chunk"]).groupBy("part", "pos").agg(F.array_sort(F.collect_list(F.struct("seq", "key", "chunk", "has"))).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = unpacker()
        for batch in batches:
            ids = [np.frombuffer(b"".join(opened(x["key"], x["chunk"], unpack) for x in row.as_py()), ID_TYPE).astype(np.int32) for row in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["part", "pos", "ids"])

    return placed(recipes(spark, root)).select("doc_id", "start", "part", "pos").join(whole.mapInArrow(run, "part int, pos bigint, ids array<int>"), ["part", "pos"]).drop("part", "pos")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, bits reversed."""
    product = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def powers(n: int) -> list[int]:
    """What the CRC of a prefix is multiplied with when 0 .. n ids (4 bytes each) follow it."""
    step, out = 1 << 31, [1 << 31]
    for _ in range(32):
        step = step >> 1 ^ (0xEDB88320 if step & 1 else 0)
    for _ in range(n):
        out.append(_times(out[-1], step))
    return out


def moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The share of each chunk's CRC in that of its document: times the power for the ids ``after`` it."""
    low, high = np.array(powers(FINE), np.uint32), [1 << 31]
    step = int(low[FINE])
    for _ in range(int(after.max(initial=0)) // FINE):
        high.append(_times(high[-1], step))
    out = crc.astype(np.uint32)
    for factor in (low[after % FINE], np.array(high, np.uint32)[after // FINE]):
        product = np.zeros(len(out), np.uint32)
        for i in range(31, -1, -1):
            product ^= np.where(factor >> np.uint32(i) & np.uint32(1), out, np.uint32(0))
            out = out >> np.uint32(1) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        out = product
    return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = moved(batch.column(3).to_numpy(), batch.column(2).to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share), batch.column(4)], names=["part", "pos", "share", "has"])


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    The CRC of a document is the exclusive or of what its chunks, as opened, add to it, so no ids are shuffled. A
    chunk that is missing or altered, lengths that don't add up and recipes that don't give the manifest's root stop the job.
    """
    if not same_root(spark, root):
        raise ValueError(f"the recipes under {root} are not those of the manifest")
    refs = _found(references(spark, root), chunks(spark, root), ["crc"]).select("part", "pos", "after", "crc", "has")
    whole = refs.mapInArrow(_shares, "part int, pos bigint, share bigint, has bigint").groupBy("part", "pos").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("has").alias("n_tokens"))
    fault = F.raise_error(F.concat(F.lit("chunks don't add up to document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("bigint")
    read = placed(recipes(spark, root)).join(whole, ["part", "pos"], "left")
    return read.select("doc_id", "start", F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(fault).alias("n_tokens"), "ids_crc32")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(spark, write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "token-store")))
