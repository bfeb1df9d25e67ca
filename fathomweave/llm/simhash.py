"""Operator 1: SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint holds, bit by bit, whether over half of a text's shingle hashes set that bit. The
covering family for radius r gives every bit a non-zero vector of r + 1 bits; table v (2^(r+1) - 1 of them)
keeps the bits whose vector has an odd inner product with v. The vectors of r differing bits span at most r
dimensions, so some v is orthogonal to all of them, and the pair agrees on everything that table v keeps:
each pair within the radius meets in some bucket, with certainty.

Within the buckets nothing is compared pair by pair. Two fingerprints differ in two bits or fewer exactly
if some 64-bit point lies within one flip of both, so each fingerprint that shares a bucket names its 65
points and fingerprints that share a point are linked through it. That is linear in the number of distinct
fingerprints, exact, and safe for groups of any size; copies were folded into one fingerprint before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomweave.llm.components import connected_components
from fathomweave.runtime import ship, write_table

BITS = 64
BLOCK = 1 << 16


def covering_masks(radius: int) -> list[int]:
    """The masks of all tables; any two 64-bit values at most ``radius`` bits apart agree under one of them."""
    size = (1 << (radius + 1)) - 1
    vector = [i % size + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(vector[i] & v).count("1") % 2) for v in range(1, size + 1)]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a whole text; 0 for null and for texts without a word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; \x20 and \x09-\x0D part words
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    n, ones, digest = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        k = min(BLOCK, n - at)
        hashes = np.fromiter((digest(next(grams), seed) for _ in range(k)), "<u8", k)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def linked(values: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v) for the distinct ``fp`` of ``values``: edges whose components are those of all pairs within ``radius`` bits (0 to 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    masks = covering_masks(max(1, radius))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    met = keyed.join(shared, ["t", "key"]).select("fp").distinct()
    flips = F.array(*[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(BITS)])
    points = met.select("fp", F.explode(F.concat(F.array(F.lit(0)), flips if radius else F.array().cast("array<bigint>"))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.col("flip") == 0).alias("own"))
    agreed = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.max("own").alias("real")).where("least <> most")
    if radius == 1:
        agreed = agreed.where("real")
        return points.join(agreed, "point").where("fp <> point").select(F.col("fp").alias("u"), F.col("point").alias("v")).distinct()
    return points.join(agreed, "point").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts, and texts without a word, have fingerprint zero and are linked like any other.
    Repeated rows are returned as often as they occur. component_id is the smallest non-null doc_id that can
    be reached (null if there is none). An empty table gives an empty result.
    """
    table, _ = write_table(fingerprints(docs, shingle, seed), "simhash")
    values = table.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    parts = connected_components(linked(values, radius))
    joined = values.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # of a component, only the fingerprints with a link beyond copies are many; the minimum has partial results
    first = joined.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_value, _ = write_table(joined.join(first, "component").select("fp", "component_id"), "simhash-components")
    return table.join(by_value, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
