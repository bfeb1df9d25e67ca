"""Graph tables made of the star schema: nodes are nations, parts, suppliers, customers; edges are orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.functions import text as tx
from fathomweave.operators import graph, name_index, store
from fathomweave.plans.tables import register, rows, table
from fathomweave.runtime import new_path
from fathomweave.streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict = {}


@register(QUERIES, ORACLE_SQL, "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events) where rn = 1")
def node_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@register(QUERIES, ORACLE_SQL, "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) where rn = 1")
def node_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_suppkey", "l_partkey", ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("seq"), F.create_map(F.lit("flag"), F.col("l_returnflag"), F.concat(F.lit("line"), F.col("l_linenumber")), F.col("l_linestatus")).alias("properties"))


@register(QUERIES, ORACLE_SQL, "select l_suppkey, l_partkey, min_by(l_returnflag, (l_orderkey * 100 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint)) as flag from lineitem group by 1, 2")
def edge_merge_first_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = graph.merge_whole(_lines(spark, sf_dir), ["l_suppkey", "l_partkey"], first=True)
    return merged.select("l_suppkey", "l_partkey", F.element_at("properties", "flag").alias("flag"))


@register(QUERIES, ORACLE_SQL, """
with e as (select l_suppkey, l_partkey, 'flag' as k, l_returnflag as v, (l_orderkey * 100 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) as seq from lineitem union all select l_suppkey, l_partkey, 'line' || l_linenumber, l_linestatus, (l_orderkey * 100 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) from lineitem)
select l_suppkey, l_partkey, k, max_by(v, seq) as v from e group by 1, 2, 3""")
def edge_merge_last_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = graph.merge_entries(_lines(spark, sf_dir), ["l_suppkey", "l_partkey"])
    return merged.select("l_suppkey", "l_partkey", F.explode("properties").alias("k", "v"))


def _stored(rows: DataFrame, keys: list[str], seq: str, policy: str) -> DataFrame:
    """``rows`` merged into a stored table in three batches, the last of them first."""
    path = new_path(rows.sparkSession, "store")
    for k in (2, 0, 1):
        store.merge(rows.where(F.pmod(F.xxhash64(seq), F.lit(3)) == k), path, keys, seq, policy)
    return store.read(rows.sparkSession, path)


@register(QUERIES, ORACLE_SQL, ORACLE_SQL["node_dedup_last"])
def store_merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return _stored(rows, ["user_id", "event_type"], "event_id", "last")


@register(QUERIES, ORACLE_SQL, ORACLE_SQL["edge_merge_first_props"])
def store_merge_edges_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _stored(_lines(spark, sf_dir), ["l_suppkey", "l_partkey"], "seq", "first")
    return merged.select("l_suppkey", "l_partkey", F.element_at("properties", "flag").alias("flag"))


@register(QUERIES, ORACLE_SQL, ORACLE_SQL["edge_merge_last_props"])
def store_merge_edges_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _stored(_lines(spark, sf_dir), ["l_suppkey", "l_partkey"], "seq", "entries")
    return merged.select("l_suppkey", "l_partkey", F.explode("properties").alias("k", "v"))


@register(QUERIES, ORACLE_SQL, """
with n as (select n_name as name, n_nationkey as id from nation union all select r_name, 100 + r_regionkey from region union all select 'NATION_' || (n_nationkey % 5), 200 + n_nationkey from nation),
e as (select 'NATION_' || (c_nationkey % 7) as s, 'NATION_' || (c_custkey % 6) as t, 'LIVES IN-' || c_mktsegment as rel from customer)
select regexp_replace(rel, '[^A-Za-z0-9_]', '_', 'g') as rel_type, count(*) as n from e join n a on a.name = e.s join n b on b.name = e.t group by 1""")
def edge_endpoint_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("node_id")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).alias("node_id"))).unionByName(nation.select(F.concat(F.lit("NATION_"), F.col("n_nationkey") % 5).alias("name"), (F.col("n_nationkey") + 200).alias("node_id")))
    c = table(spark, sf_dir, "customer")
    edges = c.select(F.concat(F.lit("NATION_"), F.col("c_nationkey") % 7).alias("source_name"), F.concat(F.lit("NATION_"), F.col("c_custkey") % 6).alias("target_name"), F.concat(F.lit("LIVES IN-"), F.col("c_mktsegment")).alias("rel_type"))
    # edges alike are counted before they meet the nodes
    few = edges.groupBy("source_name", "target_name", "rel_type").agg(F.count("*").alias("k"))
    return graph.resolve(few, nodes).groupBy("rel_type").agg(F.sum("k").alias("n"))


@register(QUERIES, ORACLE_SQL, "select o_orderkey, 'target' as missing from orders where o_custkey % 10 <> 0")
def edge_missing_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("source_name"), F.concat(F.lit("c"), F.col("o_custkey")).alias("target_name"), "o_orderkey")
    nodes = orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("name")).union(orders.where("o_custkey % 10 = 0").select(F.concat(F.lit("c"), F.col("o_custkey"))))
    return graph.missing_ends(edges, nodes).select("o_orderkey", "missing")


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("source_name"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target_name"), F.concat(F.lit("REL_"), F.col("l_returnflag")).alias("rel_type"))


@register(QUERIES, ORACLE_SQL, "with e as (select 'p' || l_partkey as name from lineitem union all select 's' || l_suppkey from lineitem) select name, count(*) as degree from e group by name order by degree desc, name limit 10")
def graph_degree_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_supplies(spark, sf_dir)).orderBy(F.col("degree").desc(), "name").limit(10)


@register(QUERIES, ORACLE_SQL, "select event_type, count(*) as n from events group by event_type")
def graph_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distribution(table(spark, sf_dir, "events"), "event_type")


@register(QUERIES, ORACLE_SQL, "select 'REL_' || l_returnflag as rel_type, count(*) as n from lineitem group by 1")
def graph_rel_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distribution(_supplies(spark, sf_dir), "rel_type")


@register(QUERIES, ORACLE_SQL, """
with r as (select * from (values ('REL_A'), ('REL_N'), ('REL_R'), ('INVOLVE')) as t(rel_type)), c as (select 'REL_' || l_returnflag as rel_type, count(*) as n from lineitem group by 1)
select r.rel_type, coalesce(n, 0) as n, coalesce(n > 0, false) as present from r left join c using (rel_type)""")
def graph_required_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.required_check(_supplies(spark, sf_dir), ["REL_A", "REL_N", "REL_R", "INVOLVE"])


@register(QUERIES, ORACLE_SQL, "select distinct c_custkey as a, o_orderkey as b, l_partkey as c from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING'")
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    first = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return graph.two_hops(first, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_partkey").alias("c")))


@register(QUERIES, ORACLE_SQL, "select p_partkey, count(distinct l_orderkey) as n_orders from part join lineitem on l_partkey = p_partkey where contains(p_name, 'ring') group by 1")
def graph_expand_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_name").contains("ring")).select("p_partkey")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey").agg(F.countDistinct("l_orderkey").alias("n_orders"))


@register(QUERIES, ORACLE_SQL, """
with recursive e as (select distinct 'p' || l_partkey as a, 's' || l_suppkey as b from lineitem union select distinct 's' || l_suppkey, 'p' || (l_partkey + 1) from lineitem where l_quantity > 45),
r as (select 'p1' as node, 0 as hops union select e.b, hops + 1 from r join e on e.a = r.node where hops < 3)
select node, min(hops) as hops from r group by node""")
def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("b")).union(li.where("l_quantity > 45").select(F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey") + 1))).distinct()
    return graph.reachable(edges, rows(spark, [("p1",)], "node string"), 3)


@register(QUERIES, ORACLE_SQL, "select distinct p_name as name from part where contains(lower(p_name), 'w') or exists (select 1 from (select unnest(string_split(lower(p_name), ' ')) as k) where starts_with(k, 'w')) order by name limit 10")
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), tx.keywords(F.col("p_name")).alias("keywords"))
    return graph.suggest(nodes, "w")


@register(QUERIES, ORACLE_SQL, ORACLE_SQL["suggest_prefix"])
def suggest_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names through the table of letter groups."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), tx.keywords(F.col("p_name")).alias("keywords"))
    folder = new_path(spark, "letters")
    name_index.write_letters(nodes, folder)
    return name_index.suggest(spark, folder, "w")


@register(QUERIES, ORACLE_SQL, "select p_partkey from part where contains(lower(p_name), 'ond c')")
def names_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name holds a run of letters, found by its groups of three."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    folder = new_path(spark, "letters")
    name_index.write_letters(part.withColumn("keywords", tx.keywords(F.col("name"))), folder)
    return part.join(name_index.holding(spark, folder, "ond c"), "name", "left_semi").select("p_partkey")


@register(QUERIES, ORACLE_SQL, "select l_orderkey, l_linenumber, md5(cast(l_partkey as varchar) || ':' || cast(l_suppkey as varchar) || ':' || l_returnflag) as uid from lineitem")
def relation_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", graph.relation_uid(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag")).alias("uid"))


@register(QUERIES, ORACLE_SQL, "select lang, source, count(*) as n, count(distinct doc_id) as docs, cast(sum(n_chars) as bigint) as chars from documents group by rollup(lang, source)")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("n_chars").alias("chars"))


@register(QUERIES, ORACLE_SQL, "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@register(QUERIES, ORACLE_SQL, """
select event_type, case when event_type in ('click', 'view') then 'u' || user_id || '_' || event_type else event_type end as scoped, count(*) as n from events group by 1, 2""")
def scoped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Step").when(F.col("event_type") == "view", "Message").otherwise("Key")
    e = table(spark, sf_dir, "events").select("event_type", graph.scoped_name(kind, F.concat(F.lit("u"), F.col("user_id")), F.col("event_type")).alias("scoped"))
    return e.groupBy("event_type", "scoped").agg(F.count("*").alias("n"))


@register(QUERIES, ORACLE_SQL, """
with kept as (select * from lineitem where l_suppkey % 4 <> 1) select l_returnflag, count(*) as n from kept where l_partkey % 4 <> 1 group by 1""")
def graph_clear_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    both = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("name"), (F.col("l_suppkey") % 4).alias("k")).union(li.select(F.concat(F.lit("p"), F.col("l_partkey")), F.col("l_partkey") % 4)).distinct()
    nodes = both.select("name", F.create_map(F.lit("procedure"), F.concat(F.lit("proc"), F.col("k"))).alias("properties"))
    edges = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_name"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target_name"), "l_returnflag")
    return graph.distribution(graph.clear_procedure(nodes, edges, "proc1")[1], "l_returnflag")
