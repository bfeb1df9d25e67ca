"""Operator 8: packing documents into sequences by minimum bin slack.

Bins are filled one after another: the longest piece left opens a bin, and a subset-sum over the lengths
still available, kept as the bits of one integer, finds the combination that leaves the least slack; it is
taken out. Pieces of one length are interchangeable, so the search runs on the number of pieces of each
length (as many numbers as a sequence has places, whatever the size of the corpus), and a combination is
taken as often as it can be found again unchanged. Which piece goes where follows from its rank among the
pieces of its length, for which no group is gathered: a task counts its own pieces of each length, and
tasks are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.llm.encode import ID_TYPE, default_tokenizer, shared_encoder
from fathomweave.runtime import ship, write_table

#: So many pieces of texts a worker keeps; the pipeline packs in executors that have grown in its other stages.
KEPT = 700_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of ``counts`` whose sum is the largest that is at most ``room``.

    Among combinations with that sum longer pieces are preferred.
    """
    reach, full, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            k = min(k, left)
            layers.append((length, k, reach))
            reach |= (reach << length * k) & full
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(layers):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return sorted(taken.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, times in each bin)]) that use up all of ``counts`` (pieces of each length, 1 to ``room``)."""
    left, plan = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n > (k == longest)}
        bin_ = dict(fullest(rest, room - longest))
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        plan.append((times, sorted(bin_.items(), reverse=True)))
    return plan


def _pieces(path: str, end_id: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64), shared_encoder(path, KEPT)
        last = np.array([end_id], ID_TYPE).tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.stream(batch.column(1)), strict=True):
                ids += last
                n = len(ids) // 4
                at, to = 0, n % room or room
                for piece in range(-(-n // room)):
                    rows.append((doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), part, int(seen[to - at])))
                    seen[to - at] += 1
                    at, to = to, to + room
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in a bin, offset), sorted: where the pieces from that rank on go."""
    rows, used, sequence = [], {}, 0
    for bins, items in plan:
        offset = 0
        for length, times in items:
            rows.append((length, used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + bins * times
            offset += length * times
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, room: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of ``docs``.

    A document's ids and ``end_id`` are one piece if they fit; otherwise pieces of ``room`` ids, the first of
    what is left over. Null and empty texts are the end id alone; repeated rows are packed as often as they
    occur; other columns are ignored; an empty table gives no sequences.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table, _ = write_table(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), end_id, room), PIECES), "pieces")
    sums = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = table.join(sums.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("rank", F.col("place") + F.col("before"))
    # at most `room` rows come to the driver
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(minimum_bin_slack(counts, room)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        keys = where[:, 0] * (1 << 48) + where[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            k = rank - where[at, 1]
            sequence, offset = where[at, 2] + k // where[at, 3], where[at, 4] + k % where[at, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
