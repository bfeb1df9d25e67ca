"""Property graph tables: deduplication, merging, endpoints, exploration, statistics.

nodes: name, entity_type, properties (map), seq; edges: source_name, target_name, rel_type, properties, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomweave.functions import lexicon as lx
from fathomweave.runtime import write_table


def first_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("rn = 1").drop("rn")


def last_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc()))).where("rn = 1").drop("rn")


def merge_whole(rows: DataFrame, keys: list[str], value: str = "properties", first: bool = False, seq: str = "seq") -> DataFrame:
    """One row a key with the value of the last (or first) row; partial sums are made before the shuffle."""
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*keys).agg(pick(value, seq).alias(value))


def merge_entries(rows: DataFrame, keys: list[str], value: str = "properties", seq: str = "seq") -> DataFrame:
    """One row a key whose map holds for each entry the value set last."""
    entries = rows.select(*keys, seq, F.explode_outer(value).alias("k", "v")).groupBy(*keys, "k").agg(F.max_by("v", seq).alias("v"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))))
    return entries.groupBy(*keys).agg(pairs.alias(value))


def safe_type(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def resolve(edges: DataFrame, nodes: DataFrame, loaded_only: bool = False) -> DataFrame:
    """An edge for each pair of nodes with the names of its ends, whatever their types; edges without both ends are dropped.

    ``loaded_only`` lets an edge see only nodes of its own or earlier documents (doc_seq).
    """
    a = nodes.select(F.col("name").alias("source_name"), F.col("node_id").alias("source_id"), *([F.col("doc_seq").alias("a_seq")] if loaded_only else []))
    b = nodes.select(F.col("name").alias("target_name"), F.col("node_id").alias("target_id"), *([F.col("doc_seq").alias("b_seq")] if loaded_only else []))
    out = edges.join(a, "source_name").join(b, "target_name").withColumn("rel_type", safe_type(F.col("rel_type")))
    return out.where("a_seq <= doc_seq and b_seq <= doc_seq").drop("a_seq", "b_seq") if loaded_only else out


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.select(F.col("name")).distinct()
    left = edges.join(names, edges["source_name"] == names["name"], "left_anti").withColumn("missing", F.lit("source"))
    return left.unionByName(edges.join(names, edges["target_name"] == names["name"], "left_anti").withColumn("missing", F.lit("target")))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(name, degree): edges at either end, a self-loop once; with ``nodes``, also those of degree 0."""
    ends = edges.select(F.col("source_name").alias("name")).unionAll(edges.where("source_name <> target_name").select(F.col("target_name").alias("name")))
    found = ends.groupBy("name").agg(F.count("*").alias("degree"))
    return found if nodes is None else nodes.select("name").distinct().join(found, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def required_check(edges: DataFrame, required: list[str] = lx.CHECKED_RELATION_TYPES) -> DataFrame:
    """(rel_type, n, present) for every required type."""
    wanted = edges.sparkSession.createDataFrame([(t,) for t in required], "rel_type string")
    return wanted.join(distribution(edges, "rel_type"), "rel_type", "left").select("rel_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("present"))


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct (source, middle, target) over two edge tables (a, b) and (b, c)."""
    return first.join(second, "b").select("a", "b", "c").distinct()


def siblings(mentions: DataFrame, start: DataFrame) -> DataFrame:
    """Rows (item) that mention an entity that ``start`` mentions, without start itself; distinct."""
    ents = mentions.join(start.select("item"), "item", "left_semi").select("entity").distinct()
    return mentions.join(ents, "entity", "left_semi").select("item").distinct().join(start.select("item"), "item", "left_anti")


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, hops): nodes within ``depth`` steps of ``roots`` (node) over directed edges (a, b).

    Each round's new nodes are written, so no plan holds those of the rounds before; a round without any is the last.
    """
    seen, _ = write_table(roots.select("node").distinct().withColumn("hops", F.lit(0)), "reached")
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        front, _ = write_table(step.withColumn("hops", F.lit(k)), "reached")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def suggest(nodes: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Distinct names that hold the query, or a keyword that starts with it, sorted."""
    q = query.lower()
    return nodes.where(F.lower("name").contains(q) | F.exists("keywords", lambda k: k.startswith(q))).select("name").distinct().orderBy("name").limit(most)


def scoped_name(kind: Column, procedure: Column, name: Column) -> Column:
    return F.when(kind.isin("NetworkFunction", "Message", "Step"), F.concat_ws("_", procedure, name)).otherwise(name)


def relation_uid(source: Column, target: Column, kind: Column) -> Column:
    return F.md5(F.concat_ws(":", source, target, kind))


def transition_columns(edges: DataFrame) -> DataFrame:
    """Adds is_transition, transition_condition and transition_action, set for FOLLOWED_BY."""
    is_ = F.col("rel_type") == "FOLLOWED_BY"
    return edges.withColumn("is_transition", is_).withColumn("transition_condition", F.when(is_, F.concat(F.lit("complete_"), F.col("source_name")))).withColumn("transition_action", F.when(is_, F.concat(F.lit("execute_"), F.col("target_name"))))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, append: bool = False) -> None:
    """Nodes by type (in place of an index for each label), edges by relation."""
    mode = "append" if append else "overwrite"
    nodes.write.mode(mode).partitionBy("entity_type").parquet(f"{folder}/nodes")
    edges.write.mode(mode).partitionBy("rel_type").parquet(f"{folder}/edges")


def clear_procedure(nodes: DataFrame, edges: DataFrame, procedure: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a procedure's nodes and the edges at them."""
    gone = nodes.where(F.element_at("properties", "procedure") == procedure).select("name").distinct()
    kept = nodes.where(F.coalesce(F.element_at("properties", "procedure") != procedure, F.lit(True)))
    left = edges.join(gone, edges["source_name"] == gone["name"], "left_anti")
    return kept, left.join(gone, left["target_name"] == gone["name"], "left_anti")
