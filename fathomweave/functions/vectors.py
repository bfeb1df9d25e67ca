"""Vector columns: cosine, weighted scores, mean pooling. All in the JVM, in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for missing vectors, vectors of different length, zero vectors and where the value is no number."""
    value = F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))).otherwise(F.lit(0.0))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, mean): element-wise mean by key, as rows; partial sums are made before the shuffle."""
    return df.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def as_vectors(means: DataFrame, key: str) -> DataFrame:
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("of"))
    return rows.select(key, F.col("of.mean").alias("vector"))
