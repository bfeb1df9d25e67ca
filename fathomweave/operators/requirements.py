"""The requirement graph: files, their sections with a vector, and the noun phrases that sections hold.

sections: key columns that tell them apart, title, text, source (a path).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomweave.functions import annotate

#: Words at which the stand-in for a noun chunker cuts.
CUTS = (
    "a an the this that these those it its they their them he she we you and or but if then else when while where which who whom whose what how as at by for from in into of off on onto "
    "out over to under up with within without via per not no is are was were be been being has have had do does did may can shall should will would must could also only such than there here"
).split()
MARKS = '[.,;:!?()\\[\\]"|]'
SPACE = "[\\x20\\x09-\\x0D]+"


def phrases(text: Column, cuts: list[str] = CUTS) -> Column:
    """The distinct runs of one to three words between marks and ``cuts``, in the order of the text; null stays null.

    A stand-in for noun chunks; those of a parser can take its place in :func:`processed`.
    """
    words = F.regexp_replace(F.regexp_replace(text, MARKS, " | "), SPACE, " ")
    runs = F.split(F.array_join(F.transform(F.split(words, " "), lambda w: F.when(F.lower(w).isin(cuts), "|").otherwise(w)), " "), "\\|")
    return F.when(text.isNotNull(), short(F.transform(runs, lambda r: F.trim(r))))


def short(chunks: Column) -> Column:
    """The distinct chunks that have words, but fewer than four."""
    return F.array_distinct(F.filter(chunks, lambda c: (c != "") & (F.size(F.split(c, SPACE)) < 4)))


def processed(sections: DataFrame, chunks: Column | None = None, load: Callable | None = None) -> DataFrame:
    """Adds entities (noun phrases, or a parser's ``chunks``), embedding (by the encoder that ``load`` makes) and the file's name as source."""
    named = sections.withColumn("entities", phrases(F.col("text")) if chunks is None else short(chunks)).withColumn("source", F.regexp_extract("source", "([^/]*)$", 1))
    return annotate.embed(named, "text", "embedding", load)


def requirement_graph(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (entity_type, name, properties) and edges (source_name, target_name, rel_type) of processed sections.

    Each row gives a Requirement of its own, named by ``key``, even if its text occurs twice; files and entities
    are merged by name. A section without a source has no file, one without entities no CONTAINS_ENTITY edge.
    """
    own = F.col(key).cast("string")
    none = F.create_map().cast("map<string,string>")
    requirements = rows.select(F.lit("Requirement").alias("entity_type"), own.alias("name"), F.map_from_arrays(F.array(F.lit("title"), F.lit("text")), F.array(F.col("title").cast("string"), F.col("text").cast("string"))).alias("properties"))
    edges = part_of(rows, key).unionByName(contains_entity(rows, key))
    merged = edges.select(F.when(F.col("rel_type") == "PART_OF", "Document").otherwise("Entity").alias("entity_type"), F.col("target_name").alias("name")).distinct().withColumn("properties", none)
    return requirements.unionByName(merged), edges


def part_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("source is not null").select(F.col(key).cast("string").alias("source_name"), F.col("source").alias("target_name"), F.lit("PART_OF").alias("rel_type"))


def contains_entity(rows: DataFrame, key: str) -> DataFrame:
    # explode alone would have the planner ask beforehand whether there are entities, and find them a second time for that
    return rows.select(F.col(key).cast("string").alias("source_name"), F.explode_outer("entities").alias("target_name"), F.lit("CONTAINS_ENTITY").alias("rel_type")).where("target_name is not null")
