"""The held-out fold and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
SCALE = 1 << 20


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of doc_id as text leaves no remainder by five; false for a null doc_id, which no model learns from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def sample_by_class(rows: DataFrame, column: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``column``, chosen by a hash of doc_id and text, so reruns agree.

    The driver sees one count for each class.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(column).count().collect()}
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(column) == value, min(SCALE, -(-SCALE * per_class // n))).otherwise(share)
    return rows.where(F.xxhash64("doc_id", "text").bitwiseAND(F.lit(SCALE - 1)) < share).limit(2 * per_class * max(1, len(counts)))
