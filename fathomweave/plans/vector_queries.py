"""Vector search over ``embeddings``: slices of a vector stand for title, parent and description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.functions import vectors as vx
from fathomweave.operators import graph, search, vector_index
from fathomweave.plans.tables import register, table
from fathomweave.runtime import new_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_D = "cast({} as double[])"
_COS = "coalesce(case when isnan(list_cosine_similarity({a}, {b})) then 0 else list_cosine_similarity({a}, {b}) end, 0)"


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), F.col("vec_id"), F.col("label"), F.col("label").cast("string").alias("entity_type"), F.slice("embedding", 1, 16).alias("title_embedding"), F.slice("embedding", 17, 16).alias("parent_embedding"), F.slice("embedding", 33, 32).alias("embedding"))


_PARTS = "cast(embedding[1:16] as double[]) as a, cast(embedding[17:32] as double[]) as b, cast(embedding[33:64] as double[]) as c"


@register(QUERIES, ORACLE_SQL, f"""
with v as (select vec_id, label, {_PARTS} from embeddings), q as (select a as qa, b as qb, c as qc from v where vec_id = 0),
s as (select vec_id, label, 1.7 * list_cosine_similarity(a, qa) + 1.7 * list_cosine_similarity(b, qb) + 16 * list_cosine_similarity(c, qc) as score from v, q)
select vec_id, label, round(score, 6) as score from s where score > 0.1 and score >= 0.3 and label in (0, 1, 2, 3, 4, 5) order by s.score desc, vec_id limit 10""")
def vector_weighted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector(spark, sf_dir, 0)
    # the three fields have their own query slices
    query = search.SearchQuery(v[32:], [str(k) for k in range(6)], own={"title": v[:16], "parent": v[16:32]})
    best = search.search(_nodes(spark, sf_dir), query).withColumn("score", F.col("final_score"))
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


@register(QUERIES, ORACLE_SQL, f"""
with v as (select vec_id, {_D.format('embedding')} as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(v.e, q.e) as score from v, v q where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, round(score, 6) as score from r where rank <= 5""")
def vector_topk_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.batched(e, _fiftieth(e), 5).withColumn("score", F.round("score", 6))


def _fiftieth(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@register(QUERIES, ORACLE_SQL, ORACLE_SQL["vector_topk_batched"])
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows through the index, all cells looked at: codes rule out what can't be among the best."""
    e, path = table(spark, sf_dir, "embeddings"), new_path(spark, "vector-index")
    vector_index.build(e, path)
    return vector_index.search(_fiftieth(e), path, 5).withColumn("score", F.round("score", 6))


#: Share of the cells that a query of ``vector_index_probed`` looks at. The tables' vectors have random directions, the
#: worst case for cells; with clusters a few cells do.
PROBED = 0.7


@register(QUERIES, ORACLE_SQL)
def vector_index_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cells alone, so only a part of the index is read; tests measure the recall."""
    e, path = table(spark, sf_dir, "embeddings"), new_path(spark, "vector-index")
    model = vector_index.build(e, path)
    return vector_index.search(_fiftieth(e), path, 5, max(1, round(PROBED * len(model.centroids)))).withColumn("score", F.round("score", 6))


@register(QUERIES, ORACLE_SQL, f"""
with v as (select vec_id, label, {_D.format('embedding')} as e from embeddings), q as (select e as qe from v where vec_id = 7),
start as (select vec_id, label, e from v, q order by list_cosine_similarity(e, qe) desc, vec_id limit 1),
sibs as (select v.vec_id, list_cosine_similarity(v.e, s.e) as similarity from v, start s where v.label = s.label and v.vec_id <> s.vec_id)
select cast(row_number() over (order by similarity desc, vec_id) as integer) as rank, vec_id as item, round(similarity, 6) as similarity from sibs order by sibs.similarity desc, vec_id limit 5""")
def vector_related_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    items = e.select(F.col("vec_id").alias("item"), "embedding")
    mentions = e.select(F.col("vec_id").alias("item"), F.col("label").alias("entity"))
    return search.focused(items, mentions, _vector(spark, sf_dir, 7)).select("rank", "item", F.round("similarity", 6).alias("similarity"))


@register(QUERIES, ORACLE_SQL, f"""
with v as (select vec_id, {_D.format('embedding')} as e from embeddings union all select -1, list_transform(range(64), lambda x: cast(0 as double))), q as (select e as qe from v where vec_id = 3)
select vec_id, round({_COS.format(a='e', b='qe')}, 6) as similarity from v, q""")
def vector_zero_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = spark.range(1).select(F.lit(-1).cast("bigint").alias("vec_id"), F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").unionByName(zero)
    return rows.select("vec_id", F.round(vx.cosine(F.col("embedding"), vx.literal_vector(_vector(spark, sf_dir, 3))), 6).alias("similarity"))


@register(QUERIES, ORACLE_SQL, """
select label, cast(d - 1 as integer) as dim, round(avg(cast(embedding[d] as double)), 6) as mean from embeddings, range(1, 65) t(d) group by label, d""")
def vector_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vx.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "dim", F.round("mean", 6).alias("mean"))


@register(QUERIES, ORACLE_SQL, """
with r as (select vec_id, label, row_number() over (partition by label order by vec_id desc) as rn from embeddings)
select label, vec_id from r where rn = 1""")
def search_index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "embeddings").select(F.col("label"), F.col("label").cast("string").alias("name"), F.col("vec_id"), F.col("vec_id").alias("seq"))
    return search.index(nodes).select("label", "vec_id")


@register(QUERIES, ORACLE_SQL, f"""
with v as (select vec_id, label, {_D.format('embedding')} as e from embeddings), q as (select e as qe from v where vec_id = 11),
s as (select label, vec_id, list_cosine_similarity(e, qe) as score from v, q), r as (select *, row_number() over (partition by label order by score desc, vec_id) as rank from s)
select label, vec_id, round(score, 6) as score from r where rank <= 3""")
def vector_topk_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", vx.cosine(F.col("embedding"), vx.literal_vector(_vector(spark, sf_dir, 11))).alias("score"))
    order = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("label", "vec_id", F.round("score", 6).alias("score"))


@register(QUERIES, ORACLE_SQL, """
select distinct b.vec_id as item from embeddings a join embeddings b on a.label = b.label where a.vec_id = 5 and b.vec_id <> 5""")
def entity_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("entity"))
    return graph.siblings(mentions, mentions.where("item = 5"))
