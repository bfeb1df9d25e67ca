"""Paragraphs to clause sections, and the lookup of parent sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomweave.functions import text as tx


def assemble(paragraphs: DataFrame, header: Column | None = None) -> DataFrame:
    """Sections of ``paragraphs`` (document, doc_seq, para_seq, style, text).

    A header opens a section; what follows, blanks left out, is its text, each paragraph after a newline;
    captions of the section's own figures are listed as well. Paragraphs before the first header are dropped.
    """
    rows = paragraphs.withColumn("text", tx.strip(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("is_header", F.coalesce(tx.is_header(F.col("style"), F.col("text")) if header is None else header, F.lit(False)))
    order = Window.partitionBy("document").orderBy("para_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_seq", F.sum(F.col("is_header").cast("int")).over(order)).where("section_seq > 0")
    rows = rows.withColumn("title", F.last(F.when(F.col("is_header"), F.col("text")), ignorenulls=True).over(order))
    rows = rows.withColumn("clause", tx.clause_number(F.col("title")))
    rows = rows.withColumn("figure", F.when(~F.col("is_header") & tx.is_own_figure(F.col("text"), F.col("clause")), F.col("text")))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("para_seq", "text")))), lambda x: F.concat(F.lit("\n"), x["text"]))
    figures = F.transform(F.array_sort(F.collect_list(F.when(F.col("figure").isNotNull(), F.struct("para_seq", "figure")))), lambda x: x["figure"])
    return rows.groupBy("document", "doc_seq", "section_seq", "title", "clause").agg(F.array_join(body, "").alias("text"), figures.alias("figures")).withColumn("has_figure", F.size("figures") > 0)


def requirement_sections(paragraphs: DataFrame) -> DataFrame:
    """Sections under heading styles only, texts joined by newlines, empty ones left out."""
    made = assemble(paragraphs, tx.is_simple_header(F.col("style")))
    return made.withColumn("text", tx.strip(F.col("text"))).where("text <> ''").select("document", "doc_seq", "section_seq", "title", "text")


def ontology_sections(paragraphs: DataFrame) -> DataFrame:
    """Sections whose clause is the header up to its first tab; what precedes the first header is under "Unknown"."""
    first = paragraphs.groupBy("document", "doc_seq").agg((F.min("para_seq") - 1).alias("para_seq")).select("document", "doc_seq", "para_seq", F.lit("Heading 0").alias("style"), F.lit("Unknown").alias("text"))
    made = assemble(first.unionByName(paragraphs.select("document", "doc_seq", "para_seq", "style", "text")), tx.is_ontology_header(F.col("style"), F.col("text")))
    return made.select(F.regexp_replace("document", "_new$", "").alias("document"), "section_seq", F.split("title", "\t")[0].alias("clause"), tx.strip(F.col("text")).alias("text")).where("text <> ''")


def recognised_sections(paragraphs: DataFrame) -> DataFrame:
    """Sections by the five header rules; a header met while its section is still empty becomes body text.

    Whether a header counts depends on the one before, so each document is walked in order: one row a document
    goes through a fold over its paragraphs.
    """
    marked = paragraphs.withColumn("text", tx.strip(F.col("text"))).where("text <> ''").withColumn("rule", tx.header_rules(F.col("style"), F.col("text")))
    docs = marked.groupBy("document", "doc_seq").agg(F.array_sort(F.collect_list(F.struct("para_seq", "rule", "text"))).alias("ps"))
    state = "struct<done:array<struct<title:string,text:string,clause:string>>,title:string,text:string,clause:string>"
    clause = r"if(regexp_extract(p.text, '^(\\d+(\\.\\d+)*|[A-Z](\\.\\d+)*)', 1) = '', 'unknown', regexp_extract(p.text, '^(\\d+(\\.\\d+)*|[A-Z](\\.\\d+)*)', 1))"
    walk = f"""aggregate(ps, cast(struct(array() as done, 'Introduction' as title, '' as text, '0' as clause) as {state}), (s, p) ->
        if(p.rule > 0 and s.text <> '', struct(concat(s.done, array(struct(s.title as title, s.text as text, s.clause as clause))) as done, p.text as title, '' as text, {clause} as clause),
           struct(s.done as done, s.title as title, if(s.text = '', p.text, concat(s.text, ' ', p.text)) as text, s.clause as clause)),
        s -> if(s.text = '', s.done, concat(s.done, array(struct(s.title as title, s.text as text, s.clause as clause)))))"""
    return docs.select("document", "doc_seq", F.posexplode(F.expr(walk)).alias("section_seq", "s")).select("document", "doc_seq", "section_seq", "s.title", "s.text", "s.clause")


def with_parents(sections: DataFrame, same_document: bool = False) -> DataFrame:
    """Adds parent_title: the title of the section with the parent clause, the last one in load order.

    As a rule the parent may stand in any document; ``same_document`` keeps it within.
    """
    keys = ["document", "clause"] if same_document else ["clause"]
    last = Window.partitionBy(*keys).orderBy(F.col("doc_seq").desc(), F.col("section_seq").desc())
    parents = sections.withColumn("rn", F.row_number().over(last)).where("rn = 1").select(*([F.col("document").alias("p_document")] if same_document else []), F.col("clause").alias("p_clause"), F.col("title").alias("parent_title"))
    own = sections.withColumn("wanted", tx.parent_clause(F.col("clause")))
    on = own["wanted"] == parents["p_clause"]
    if same_document:
        on = on & (own["document"] == parents["p_document"])
    return own.join(parents, on, "left").drop("wanted", "p_clause", "p_document")
