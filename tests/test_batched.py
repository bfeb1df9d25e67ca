import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomweave.functions import vectors as vx
from fathomweave.operators import search
from tests.llm.common import bag


def plain(vectors, queries, k):
    rows = vectors.crossJoin(queries).select("query_id", "vec_id", vx.cosine(F.col("embedding"), F.col("q")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def test_blocks_give_the_rows_of_all_pairs(spark, monkeypatch):
    """Copies, odd vectors and a null vec_id, which stands last; in blocks far smaller than the table."""
    for name, value in (("VECTORS", 16), ("BLOCK", 8), ("TOGETHER", 8), ("PAIRS", 32)):
        monkeypatch.setattr(search, name, value)
    r = random.Random(1)
    v = [[r.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(4)] for _ in range(60)]
    odd = [None, [1.0, None, 0.0, 1.0], [0.0] * 4, [1.0, 2.0], [float("nan")] * 4, [1e-170] * 4, [float("inf"), 1.0, 1.0, 1.0], []]
    rows = [(i, v[i % 60] if i < 150 else v[0]) for i in range(200)] + [(300 + 5 * i, x) for i, x in enumerate(odd)] + [(None, v[1]), (None, [7.0, 1.0, 2.0, 3.0]), (3, v[3])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    columns = ["query_id", "rank", "vec_id", "score"]
    for k in (1, 5, 250):
        assert bag(search.batched(vectors, queries, k), *columns) == bag(plain(vectors, queries, k), *columns)


def test_pairs_are_no_rows(spark):
    """The plan holds blocks and the best of each task, not a row a pair."""
    e = spark.range(10).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    plan = search.batched(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 2)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "CartesianProduct" in plan
