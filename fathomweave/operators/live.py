"""The live build in one go: sections to procedures, steps, validated entities, relations, vectors, and a stored graph.

sections: document, doc_seq, section_seq, title, clause, text, has_figure, as :mod:`sections` makes them. Nothing is
looped over on the driver; documents of any number are built together and merged into the store as one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.functions import annotate
from fathomweave.functions import lexicon as lx
from fathomweave.functions import text as tx
from fathomweave.functions import vectors as vx
from fathomweave.operators import build, classify, extract, fsm, graph, relate, requirements, sections, sinks, steps, store
from fathomweave.runtime import drop_table, shuffle_partitions, write_table

LISTS = {"network_functions": "NetworkFunction", "messages": "Message", "parameters": "Parameter", "keys": "Key"}
VECTORS = ["embedding", "title_embedding", "parent_title_embedding"]


def lexicon_names(text: Column) -> Column:
    """struct of the five lists: what the lexicons and the message patterns find in a text."""
    empty = F.array().cast("array<string>")

    def found(runs: Column) -> Column:
        listed = lambda words: extract.matches(text, words, among=runs)
        lists = {
            "network_functions": listed(lx.NETWORK_FUNCTIONS), "parameters": extract.merged(listed(lx.PARAMETERS), empty), "keys": extract.merged(listed(lx.KEYS), empty),
            "messages": extract.merged(listed(lx.MESSAGES), extract.pattern_messages(text)), "steps": empty,
        }
        return F.struct(*[c.alias(k) for k, c in lists.items()])

    # the text is cut into runs once for all lists
    return F.get(F.transform(F.array(extract.runs_in(text, [*lx.NETWORK_FUNCTIONS, *lx.PARAMETERS, *lx.KEYS, *lx.MESSAGES])), found), F.lit(0))


def procedures(found: DataFrame, named: Column | None = None, names: Callable[[Column], Column] = lexicon_names, answer: str | None = None, **lists: list[str]) -> DataFrame:
    """One row for each section that describes a procedure: section (its key), procedure, parent_title, clause, document, text, the lists, steps and description.

    ``named``: what a model calls the section's procedure; ``answer``: a column of a model's steps for procedures whose text has none.
    A procedure in which nothing at all is found has the least entities that its name asks for. Null texts are empty.
    """
    rows = sections.with_parents(found.withColumn("text", F.coalesce("text", F.lit(""))))
    # patterns take far longer than reading, and a file may be one task
    rows = rows.repartition(shuffle_partitions(found.sparkSession), "document", "section_seq")
    own = classify.identify(rows, named, **lists).withColumn("procedure", F.col("procedure_name")).withColumn("section", F.concat_ws("#", "document", "section_seq"))
    wide = steps.in_rows(own, "procedure", "text", answer)
    said = F.array_join(F.col("steps.description"), " ")
    # a column of its own, as each list is looked at several times
    wide = wide.withColumn("names", names(F.col("text")))
    checked = build.validated(F.col("names"), F.col("text"), said)
    wide = build.with_entities(wide.withColumn("names", checked).withColumn("steps_", F.col("steps")), "names").withColumn("steps", F.col("steps_")).drop("steps_")
    nothing = F.size("network_functions") + F.size("messages") + F.size("parameters") + F.size("keys") + F.size("steps") == 0
    least = extract.least_entities(F.col("procedure"))
    wide = wide.withColumns({k: F.when(nothing, least[k]).otherwise(F.col(k)) for k in LISTS})
    return described(wide)


def described(procedures: DataFrame) -> DataFrame:
    return procedures.withColumn("description", extract.search_description(F.col("parent_title"), F.col("procedure"), F.col("steps.description"), F.col("text")))


def all_nodes(found: DataFrame) -> DataFrame:
    """name, entity_type, properties, description, parent_title, seq for every entity of :func:`procedures`, with document and k, its place among them: procedures, functions, messages, parameters, keys and steps in this order."""
    place = F.struct("doc_seq", "document", "section_seq")
    text_map = lambda **of: F.map_filter(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    common = {"procedure": F.col("procedure"), "clause": F.col("clause")}
    none = F.lit(None).cast("string")

    def one(k: int, name: Column, kind: str, properties: Column, description: Column, parent: Column = none) -> Column:
        own = {"k": F.lit(k), "name": name, "entity_type": F.lit(kind), "properties": properties, "description": description, "parent_title": parent}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    own = F.array(one(0, F.col("procedure"), "Procedure", text_map(clause=F.col("clause"), document=F.col("document"), has_figure=F.col("has_figure"), text=F.col("text")), F.col("description"), F.col("parent_title")))
    listed = lambda k, c, kind: F.transform(c, lambda x: one(k, x, kind, text_map(**common), none))
    parts = [own] + [listed(i + 1, c, kind) for i, (c, kind) in enumerate(LISTS.items())]
    step = lambda s: one(5, s["name"], "Step", text_map(**common, step_number=steps.number_in_name(s["name"])), s["description"])
    digits = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    seq = F.concat_ws("#", digits("doc_seq"), "document", digits("section_seq"))
    rows = found.select("document", place.alias("place"), seq.alias("seq"), F.explode(F.concat(*parts, F.transform("steps", step))).alias("n"))
    return rows.select("n.name", "n.entity_type", "n.properties", "n.description", "n.parent_title", "seq", "document", "place", "n.k")


def first_nodes(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Of :func:`all_nodes` in each document the first node of a name and type, as far as sections go. ``by``: columns that rows of a name and type have in common."""
    keys = [*by, "name", "entity_type"]
    own = ["properties", "description", "parent_title", "seq"]
    first = rows.groupBy(*keys, "document").agg(F.min_by(F.struct(*own), F.struct("place", "k")).alias("n"))
    return first.select(*keys, *[f"n.{c}" for c in own])


def nodes_of(found: DataFrame) -> DataFrame:
    """name, entity_type, properties, description, parent_title, seq for every entity of :func:`procedures`: in each document :func:`first_nodes`."""
    return first_nodes(all_nodes(found))


def edges_of(found: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """source_name, target_name, rel_type and properties of all relations of :func:`procedures`."""
    rows = relate.required(found, annotated)
    kept = ["relationship_type", "extraction_method", "confidence", "sequence_order", "procedure"]
    pairs = F.map_filter(F.create_map(*[x for c in kept for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    return rows.select("source_name", "target_name", graph.safe_type(F.col("rel_type")).alias("rel_type"), pairs.alias("properties"))


def with_vectors(nodes: DataFrame, load: Callable | None = None) -> DataFrame:
    """Adds the vectors of description (with name, type and keywords), title and parent title; where one of these is missing, so is its vector. Vectors that nodes have already stay."""
    words = tx.keywords("name", "entity_type", "description")
    said = {
        "embedding": F.when(F.coalesce("description", F.lit("")) != "", extract.embedding_text(F.col("name"), F.col("entity_type"), words, F.col("description"))),
        "title_embedding": F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("Title: "), "name")),
        "parent_title_embedding": F.when(F.coalesce("parent_title", F.lit("")) != "", F.concat(F.lit("Parent Section: "), "parent_title")),
    }
    had = {c: f"_{c}" for c in said if c in nodes.columns}
    asked = {c: F.when(F.col(c).isNull(), text) if c in had else text for c, text in said.items()}
    made = annotate.embed_all(nodes, {had.get(c, c): text for c, text in asked.items()}, load)
    return made.withColumns({c: F.coalesce(c, new) for c, new in had.items()}).drop(*had.values())


def build_graph(
    found: DataFrame, folder: str, named: Column | None = None, names: Callable[[Column], Column] = lexicon_names, answer: str | None = None, load: Callable | None = None,
    buckets: int = store.BUCKETS, **lists: list[str],
) -> tuple[DataFrame, DataFrame]:
    """Builds the graph of all sections and merges it into the store under ``folder``; returns its nodes and its edges.

    Edges whose ends are not among the stored nodes are not stored. Nodes of a name and type are merged entry by entry, later documents win. Building the
    same sections again changes nothing. Without a procedure nothing is written and both are empty.
    """
    spark = found.sparkSession
    kept = ["document", "doc_seq", "section_seq", "clause", "has_figure", "text", "procedure", "parent_title", *LISTS, "steps"]
    wide, path = write_table(procedures(found, named, names, answer, **lists).select(*kept), "procedures", compression="zstd")
    empty = {c: F.lit(None).cast("array<float>") for c in VECTORS}
    # texts are moved once, to the buckets of their nodes; the first of each document is found there, and vectors are made of what is stored
    store.merge(
        all_nodes(described(wide)).withColumns(empty), f"{folder}/nodes", ["name", "entity_type"], "seq", "entries", buckets,
        within=lambda rows, by: first_nodes(rows, by).withColumns(empty), after=lambda rows: with_vectors(rows, load),
    )
    # each end is a name of the same procedures, whose nodes have just been stored
    edges = edges_of(wide).where("source_name is not null and target_name is not null")
    # the text of its properties tells relations of one kind between two names apart
    uid = F.md5(F.to_json(F.struct("source_name", "target_name", "rel_type", "properties")))
    edges = edges.select("source_name", "target_name", "rel_type", "properties", uid.alias("uid"), F.lit(0).cast("bigint").alias("seq"))
    # ten relations are looked for in every procedure, which takes longer than writing what is found
    store.merge(edges, f"{folder}/edges", ["uid"], "seq", "last", buckets)
    drop_table(spark, path)
    return read_graph(spark, folder)


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return store.read(spark, f"{folder}/nodes").drop("seq"), store.read(spark, f"{folder}/edges").drop("uid", "seq")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by type and edges by relation."""
    a = nodes.groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return a.unionByName(edges.groupBy(F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def section_key(found: DataFrame) -> DataFrame:
    return found.withColumn("section", F.concat_ws("#", F.lpad(F.col("doc_seq").cast("string"), 10, "0"), "document", F.lpad(F.col("section_seq").cast("string"), 10, "0")))


def recognised_entities(found: DataFrame, recogniser: Callable | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """(section, name, entity_type, method_ord, pos, ord) of all sections with text enough: recogniser, known functions, patterns and parser labels, merged.

    ``recogniser``: makes the model for ``annotate.recognise``; ``labelled``: a parser's entities by section, see ``extract.recognised``.
    """
    rows = extract.substantial(found)
    hits = extract.from_recogniser(annotate.recognise(extract.pieces(rows, "section"), "context", "hits", recogniser), "section")
    made = extract.recognised(rows, "section", hits=hits, labelled=labelled)
    return made.withColumn("ord", F.row_number().over(Window.partitionBy("section").orderBy("method_ord", "pos", "name")))


def recognised_edges(found: DataFrame, entities: DataFrame, parser: Callable | None = None) -> DataFrame:
    """(section, source_name, target_name, rel_type, method, properties): by verbs, by shared sentences and by templates, in sections with two names or more."""
    names = entities.groupBy("section").agg(F.array_sort(F.collect_set("name")).alias("names")).where("size(names) > 1")
    rows = found.join(names, "section").select("section", "text", "names")

    def edge(df: DataFrame, order: int, **of: Column) -> DataFrame:
        pairs = F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("string"))])
        return df.select("section", "source_name", "target_name", "rel_type", F.lit(order).alias("method"), pairs.alias("properties"))

    verbs = [v for vs in lx.VERB_RELATIONS.values() for v in vs]
    spoken = relate.verb_relations(annotate.parse(rows, "text", "tokens", verbs, parser), "section")
    sentences = rows.select("section", F.posexplode(tx.sentences(F.col("text"))).alias("sent", "text"))
    beside = relate.co_occurrence(entities.join(names.select("section"), "section", "left_semi"), sentences)
    fixed = relate.template_pairs(rows)
    out = edge(spoken, 1, verb=F.col("verb"), confidence=F.lit("0.8")).unionByName(edge(beside, 2, confidence=F.lit("0.6"), method=F.lit("cooccurrence")))
    return out.unionByName(edge(fixed, 3, method=F.lit("template"), confidence=F.lit("0.7")))


def recognised_graph(found: DataFrame, folder: str, recogniser: Callable | None = None, parser: Callable | None = None, labelled: Callable[[DataFrame], DataFrame] | None = None, buckets: int = store.BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The graph of the entity-recognition builder: ``found`` as ``sections.recognised_sections`` makes them; returns its stored nodes and edges.

    The first node of a name and type counts; edges are merged by ends and relation, each property as it was set last, by the place of the section
    and then by method. Building the same sections again changes nothing.
    """
    spark = found.sparkSession
    rows = section_key(found)
    entities, path = write_table(recognised_entities(rows, recogniser, labelled(rows) if labelled else None), "recognised")
    method = F.element_at(F.array(*[F.lit(x) for x in ("recogniser", "known_nf", "pattern", "parser")]), F.col("method_ord"))
    placed = entities.join(rows.select("section", "clause", "title"), "section")
    known = F.create_map(F.lit("discovery_method"), method, F.lit("source_clause"), F.coalesce("clause", F.lit("unknown")), F.lit("source_section"), F.coalesce("title", F.lit("unknown")))
    seq = F.concat_ws("#", "section", F.lpad(F.col("ord").cast("string"), 10, "0"))
    nodes = placed.select("name", "entity_type", known.alias("properties"), seq.alias("seq"))
    store.merge(nodes, f"{folder}/nodes", ["name", "entity_type"], "seq", "first", buckets)
    edges = recognised_edges(rows, entities, parser).withColumn("seq", F.concat_ws("#", "section", "method")).select("source_name", "target_name", "rel_type", "properties", "seq")
    store.merge(edges, f"{folder}/edges", ["source_name", "target_name", "rel_type"], "seq", "entries", buckets)
    drop_table(spark, path)
    return store.read(spark, f"{folder}/nodes").drop("seq"), store.read(spark, f"{folder}/edges").drop("seq")


def requirement_graph(paragraphs: DataFrame, folder: str, chunks: Column | None = None, load: Callable | None = None, buckets: int = store.BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The requirement graph of Word paragraphs: sections under heading styles, their noun phrases and files; returns its stored nodes and edges."""
    spark = paragraphs.sparkSession
    made = sections.requirement_sections(paragraphs).withColumn("source", F.concat("document", F.lit(".docx")))
    rows = requirements.processed(section_key(made), chunks, load)
    nodes, edges = requirements.requirement_graph(rows, "section")
    own = nodes.join(rows.select(F.col("section").alias("name"), F.lit("Requirement").alias("entity_type"), "embedding"), ["name", "entity_type"], "left")
    store.merge(own.withColumn("seq", F.lit(0)), f"{folder}/nodes", ["name", "entity_type"], "seq", "last", buckets)
    store.merge(edges.withColumn("seq", F.lit(0)), f"{folder}/edges", ["source_name", "target_name", "rel_type"], "seq", "last", buckets)
    return store.read(spark, f"{folder}/nodes").drop("seq"), store.read(spark, f"{folder}/edges").drop("seq")


def best_procedures(nodes: DataFrame, queries: DataFrame, k: int = 3, threshold: float = 0.2) -> DataFrame:
    """(query_id, rank, procedure, score): the ``k`` best procedures of each query (query_id, q) by the weighted scores of all three vectors."""
    own = nodes.where("entity_type = 'Procedure'").select("name", *VECTORS)
    for c in VECTORS:
        own = own.withColumn(f"{c}_n", vx.norm(F.col(c)))
    asked = queries.select("query_id", "q", vx.norm(F.col("q")).alias("n"))
    pairs = own.crossJoin(asked.hint("shuffle_replicate_nl"))
    one = lambda c: F.coalesce(vx.cosine(F.col(c), F.col("q"), F.col(f"{c}_n"), F.col("n")), F.lit(0.0))
    w = lx.SEARCH_WEIGHTS
    score = F.lit(w["description"]) * one("embedding") + F.lit(w["title"]) * one("title_embedding") + F.lit(w["parent"]) * one("parent_title_embedding")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name")
    rows = pairs.withColumn("score", score).where((F.col("score") > 0.1) & (F.col("score") >= threshold))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("name").alias("procedure"), "score")


def demonstrate(nodes: DataFrame, edges: DataFrame, queries: DataFrame, folder: str, k: int = 3) -> DataFrame:
    """:func:`best_procedures` of all queries, with the machine of each query's best written as JSON and DOT under ``folder``.

    Adds states, transitions, errors (rules that the machine breaks) and files to the rows of rank 1 whose procedure has steps.
    """
    found, _ = write_table(best_procedures(nodes, queries, k), "best")
    drawn = found.where("rank = 1").select("procedure").distinct()
    step = nodes.where("entity_type = 'Step'").select(F.col("properties")["procedure"].alias("procedure"), "name", "description", "entity_type").join(drawn, "procedure", "left_semi")
    sent = edges.where("rel_type = 'SEND'").select(F.col("properties")["procedure"].alias("procedure"), "source_name", "target_name").distinct()
    order = Window.partitionBy("procedure", "source_name").orderBy("target_name")
    sends = sent.join(drawn, "procedure", "left_semi").withColumn("ord", F.row_number().over(order))
    made, path = write_table(fsm.states(step), "states")
    moves, moves_path = write_table(fsm.transitions(step, sends), "moves")
    files = sinks.write_machines(fsm.to_json(made, moves), "json", folder, "json", "_fsm").unionByName(sinks.write_machines(fsm.to_dot(made, moves), "dot", folder, "dot", "_fsm"))
    told = made.groupBy("procedure").agg(F.count("*").alias("states")).join(moves.groupBy("procedure").agg(F.count("*").alias("transitions")), "procedure", "left")
    told = told.join(fsm.violations(made, moves).groupBy("procedure").agg(F.count("*").alias("errors")), "procedure", "left")
    told = told.join(files.groupBy("procedure").agg(F.array_sort(F.collect_set("file")).alias("files")), "procedure", "left").na.fill(0, ["transitions", "errors"])
    told, _ = write_table(told.withColumn("rank", F.lit(1)), "machines")
    for done in (path, moves_path):
        drop_table(spark=nodes.sparkSession, path=done)
    return found.join(told, ["procedure", "rank"], "left").select("query_id", "rank", "procedure", "score", "states", "transitions", "errors", "files")
