"""From sections to a stored graph and back: ontology entities, their relations, validation, scoping, loading.

sections: document, clause, text; entities: document, clause, name, entity_type; edges: source_name, target_name, rel_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomweave.functions import lexicon as lx
from fathomweave.functions import text as tx
from fathomweave.operators import extract, graph, relate
from fathomweave.runtime import write_table

#: Functions whose nodes belong to a procedure.
SCOPED = [
    "AMF", "SMF", "UPF", "AUSF", "UDM", "PCF", "NRF", "NEF", "NSSF",
    "UDR", "UDSF", "CHF", "BSF", "SEPP", "TNGF", "N3IWF", "W-AGF",
    "SMSF", "TSCTSF", "NSACF", "SCP", "GNB", "NG-ENB",
]
# End of the fixed values.


def ontology_entities(sections: DataFrame, strict: bool = False) -> DataFrame:
    """(document, clause, name, entity_type): the ontology's names in each section, whole words in any case.

    A name of two types is found under both. ``strict`` finds words that end in a mark as well. A null text has none.
    """
    found = F.array(*[F.struct(F.lit(kind).alias("entity_type"), extract.matches(F.col("text"), names, strict).alias("names")) for kind, names in lx.ONTOLOGY.items()])
    rows = sections.select("document", "clause", F.explode(found).alias("x"))
    return rows.select("document", "clause", F.explode("x.names").alias("name"), "x.entity_type")


def contained(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """CONTAINS edges from a section's first entity (by name) to the keys and parameters that its text names, in the case given."""
    first = entities.groupBy("document", "clause").agg(F.min("name").alias("source_name"))
    words = list(dict.fromkeys(lx.ONTOLOGY["Key"] + lx.ONTOLOGY["Parameter"]))
    said = F.array_compact(F.array(*[F.when(F.col("text").contains(w), F.lit(w)) for w in words]))
    return sections.join(first, ["document", "clause"]).select("document", "clause", "source_name", F.explode(said).alias("target_name"), F.lit("CONTAINS").alias("rel_type"))


def part_of(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """PART_OF edges from each entity of a section to the procedures that its text names, in the case given."""
    said = F.array_compact(F.array(*[F.when(F.col("text").contains(w), F.lit(w)) for w in lx.ONTOLOGY["Procedure"]]))
    named = sections.select("document", "clause", F.explode(said).alias("target_name"))
    return entities.join(named, ["document", "clause"]).where("name <> target_name").select("document", "clause", F.col("name").alias("source_name"), "target_name", F.lit("PART_OF").alias("rel_type")).distinct()


def third_party(names: Column, source: Column, key: Column) -> Column:
    """The first of ``names`` that is neither the source nor the derived key, where there are more than two; else null."""
    return F.when(F.size(names) > 2, F.get(F.array_except(names, F.array(source, key)), F.lit(0)))


def spoken(sections: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Message entities and the edges of what sections say: SENDS_TO, IS_SENT_TO, SENT_BY, DERIVES, DERIVED_FROM between names found there."""
    names = entities.groupBy("document", "clause").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = sections.join(names, ["document", "clause"]).select(F.struct("document", "clause").alias("section"), "names", "text")
    sent = relate.sends(rows)
    edges = sent.unionByName(relate.derives(rows.where("size(names) > 1")).drop("sent")).select("section.document", "section.clause", "source_name", "target_name", "rel_type")
    messages = sent.where("rel_type = 'SENDS_TO'").select("section.document", "section.clause", F.col("target_name").alias("name"), F.lit("Message").alias("entity_type")).distinct()
    return messages, edges


def from_sections(sections: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities, messages among them, and edges of all sections. The names found are written once, for all that ask for them."""
    entities, _ = write_table(ontology_entities(sections, strict), "ontology")
    messages, edges = spoken(sections, entities)
    entities = entities.unionByName(messages)
    return entities, edges.unionByName(contained(sections, entities.where("entity_type <> 'Message'"))).unionByName(part_of(sections, entities))


def specification(document: Column) -> Column:
    """struct(name, document, version) of a specification's file stem such as 33501-i60_new."""
    name = F.regexp_replace(document, "_new", "")
    parts = F.split(name, "-")
    return F.struct(name.alias("name"), F.concat(F.lit("TS "), F.get(parts, F.lit(0))).alias("document"), F.get(parts, F.lit(1)).alias("version"))


def graph_of_sections(sections: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, entity_type, properties) and distinct edges of all files; each file has a node of its own. The last section's properties win."""
    entities, edges = from_sections(sections, strict)
    order = F.struct("document", "clause")
    nodes = entities.groupBy("name", "entity_type").agg(F.max(order).alias("x")).select("name", "entity_type", F.create_map(F.lit("source_clause"), F.col("x.clause"), F.lit("source_document"), F.col("x.document")).alias("properties"))
    files = sections.select(specification(F.col("document")).alias("s")).distinct().select("s.name", F.lit("Specification").alias("entity_type"), F.create_map(F.lit("document"), F.col("s.document"), F.lit("version"), F.col("s.version")).alias("properties"))
    return nodes.unionByName(files), edges.select("source_name", "target_name", "rel_type").distinct()


def validated(names: Column, text: Column, step_text: Column) -> Column:
    """``names`` (struct of network_functions, parameters, keys, messages, steps) after each list's own test; steps pass."""
    return F.struct(
        extract.valid_functions(names["network_functions"], step_text).alias("network_functions"), extract.valid_parameters(names["parameters"], text).alias("parameters"),
        extract.valid_keys(names["keys"], text).alias("keys"), extract.valid_messages(names["messages"], text).alias("messages"), names["steps"].alias("steps"),
    )


def with_entities(procedures: DataFrame, names: str = "names") -> DataFrame:
    """Puts the five lists of the struct ``names`` beside the procedure's own columns, null lists as empty ones."""
    lists = ["network_functions", "messages", "parameters", "keys", "steps"]
    return procedures.withColumns({k: F.coalesce(F.col(names)[k], F.array().cast("array<string>")) for k in lists}).drop(names)


def scoped(edges: DataFrame, procedure: str = "procedure") -> DataFrame:
    """Edges whose ends, where they are functions of SCOPED, carry their procedure's name in front; the procedure is among the properties."""
    end = lambda c: F.when(F.col(c).isin(SCOPED), F.concat_ws("_", F.col(procedure), F.col(c))).otherwise(F.col(c))
    own = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: k != "procedure")
    return edges.withColumn("source_name", end("source_name")).withColumn("target_name", end("target_name")).withColumn("properties", F.map_concat(own, F.create_map(F.lit("procedure"), F.col(procedure))))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> bool:
    """Writes nodes by type (the last of a name and type wins) and merged edges under ``folder``; nothing at all if there are no nodes.

    nodes: name, entity_type, properties, seq and what else is stored with them; edges: as in :mod:`graph`.
    """
    if nodes.isEmpty():
        return False
    graph.last_wins(nodes, ["name", "entity_type"]).write.mode("overwrite").partitionBy("entity_type").parquet(f"{folder}/nodes")
    merged = graph.merge_entries(edges, ["source_name", "target_name", "rel_type"])
    merged.write.mode("overwrite").partitionBy("rel_type").parquet(f"{folder}/edges")
    return True


def read_graph(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as they were stored; a node without a type is Unknown, one without a name has the empty one."""
    nodes = spark.read.parquet(f"{folder}/nodes")
    nodes = nodes.withColumn("entity_type", F.coalesce(F.col("entity_type").cast("string"), F.lit("Unknown"))).withColumn("name", F.coalesce("name", F.lit("")))
    return nodes, spark.read.parquet(f"{folder}/edges")


def steps_of(nodes: DataFrame, procedure: str) -> DataFrame:
    """The Step nodes whose property ``procedure`` is that one, by natural order of names."""
    return nodes.where((F.col("entity_type") == "Step") & (F.col("properties")["procedure"] == procedure)).orderBy(tx.natural_key("name"), "name")


def touching(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges with either end among ``names`` (name), each once."""
    known = names.select("name").distinct()
    left = edges.join(known.withColumnRenamed("name", "source_name"), "source_name", "left_semi")
    right = edges.join(known.withColumnRenamed("name", "target_name"), "target_name", "left_semi")
    right = right.join(known.withColumnRenamed("name", "source_name"), "source_name", "left_anti")
    return left.unionByName(right.select(left.columns))
