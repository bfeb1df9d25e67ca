"""Typed relations of a procedure, each a projection of one wide row, so nothing is joined or shuffled.

``procedures``: procedure, network_functions, messages, parameters, keys (arrays of strings) and steps
(array of struct ord, name, description), in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomweave.functions import lexicon as lx

EDGE = ["procedure", "source_name", "target_name", "rel_type", "relationship_type", "extraction_method", "confidence", "sequence_order"]


def _edges(rows: DataFrame, source: Column, target: Column, kind: str, role: str | None, method: str, confidence: float | None = None, order: Column | None = None) -> DataFrame:
    return rows.select("procedure", source.alias("source_name"), target.alias("target_name"), F.lit(kind).alias("rel_type"), F.lit(role).cast("string").alias("relationship_type"), F.lit(method).alias("extraction_method"), F.lit(confidence).cast("double").alias("confidence"), (F.lit(None) if order is None else order).cast("int").alias("sequence_order"))


def _steps(procedures: DataFrame, other: str | None = None) -> DataFrame:
    rows = procedures.select("*", F.posexplode("steps").alias("at", "step"))
    return rows.select("*", F.posexplode(other).alias("other_at", "other")) if other else rows


def _said(prefix: str) -> Column:
    """The description in lower case; what stands for a missing one."""
    d = F.col("step.description")
    return F.lower(F.when(d.isNull() | (d == ""), F.concat(F.lit(prefix), F.col("step.name"))).otherwise(d))


def part_of(p: DataFrame) -> DataFrame:
    return _edges(_steps(p), F.col("step.name"), F.col("procedure"), "PART_OF", "containment", "required_relationship")


def followed_by(p: DataFrame) -> DataFrame:
    # each step with the next one's name, so that no row carries all steps of its procedure
    pairs = F.transform("steps", lambda s, i: F.struct(s["name"].alias("name"), F.get(F.col("steps"), i + 1)["name"].alias("next"), (i + 1).alias("ord")))
    rows = p.select("procedure", F.explode(pairs).alias("x")).where("x.next is not null")
    return _edges(rows, F.col("x.name"), F.col("x.next"), "FOLLOWED_BY", None, "required_relationship", order=F.col("x.ord"))


def invoke(p: DataFrame) -> DataFrame:
    return _edges(p.select("procedure", F.explode("network_functions").alias("nf")), F.col("procedure"), F.col("nf"), "INVOKE", "invocation", "step_validated_relationship")


def involve(p: DataFrame) -> DataFrame:
    nf = F.lower("other")
    hit = _said("Step involving ").contains(nf) | F.lower("step.name").contains(nf) | F.exists("messages", lambda m: F.lower(m).contains(F.lower(F.col("other"))))
    return _edges(_steps(p.where("procedure is not null"), "network_functions").where(hit), F.col("other"), F.col("step.name"), "INVOLVE", "involvement", "step_content_analysis", 0.9)


def contains(p: DataFrame, what: str = "parameters") -> DataFrame:
    rows = _steps(p, what).where(_said("Step ").contains(F.lower("other")))
    return _edges(rows, F.col("step.name"), F.col("other"), "CONTAINS", "containment", "parameter_detection" if what == "parameters" else "key_detection", 0.9)


def contains_default(p: DataFrame) -> DataFrame:
    """Where no step holds a parameter or key: the first 3 steps with the first 5 parameters."""
    text = lambda s: F.lower(F.when(s["description"].isNull() | (s["description"] == ""), F.concat(F.lit("Step "), s["name"])).otherwise(s["description"]))
    any_ = F.exists("steps", lambda s: F.exists(F.concat("parameters", "keys"), lambda x: text(s).contains(F.lower(x))))
    rows = p.where(~any_).select("procedure", F.explode(F.slice("steps", 1, 3)).alias("step"), F.slice("parameters", 1, 5).alias("ps")).select("procedure", "step", F.explode("ps").alias("other"))
    return _edges(rows, F.col("step.name"), F.col("other"), "CONTAINS", "containment", "default_parameter_assignment", 0.6)


def send(p: DataFrame) -> DataFrame:
    said, m = _said("Step "), F.lower("other")
    hit = said.contains(m) | F.lower("step.name").contains(m) | said.rlike("send|transmit|forward|request|response")
    return _edges(_steps(p, "messages").where(hit), F.col("step.name"), F.col("other"), "SEND", "message_transmission", "message_detection")


def send_by(p: DataFrame) -> DataFrame:
    rows = p.select("procedure", F.explode("messages").alias("m"), "network_functions").select("procedure", "m", F.explode("network_functions").alias("nf"))
    hit = F.lower("m").contains(F.lower("nf")) | F.lower("m").rlike("request|response|notification")
    return _edges(rows.where(hit), F.col("m"), F.col("nf"), "SEND_BY", "message_origin", "nf_message_correlation")


def send_to(p: DataFrame) -> DataFrame:
    rows = p.select("procedure", F.explode("messages").alias("m"), "network_functions")
    rows = rows.withColumn("nf", F.try_element_at(F.filter("network_functions", lambda n: ~F.lower(F.col("m")).contains(F.lower(n))), F.lit(1))).where("nf is not null")
    return _edges(rows, F.col("m"), F.col("nf"), "SEND_TO", "message_destination", "nf_message_correlation")


def required(p: DataFrame, annotated: DataFrame | None = None, defaults: bool = True) -> DataFrame:
    """All relations of ``procedures``, with those of an annotator (same columns) if there are any; ``defaults``: also :func:`contains_default`."""
    out = part_of(p)
    for rows in (followed_by(p), invoke(p), involve(p), contains(p), contains(p, "keys"), *([contains_default(p)] if defaults else []), send(p), send_by(p), send_to(p)):
        out = out.unionByName(rows)
    return out if annotated is None else annotated.select(*EDGE).unionByName(out)


def from_annotation(rows: DataFrame) -> DataFrame:
    """Relations in a model's answer (procedure, answer): the first {...} as JSON, at most 15, of known types."""
    one = "struct<source:string,target:string,type:string>"
    parsed = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), f"struct<relationships:array<{one}>>")
    found = rows.select("procedure", F.explode(F.slice(parsed["relationships"], 1, 15)).alias("r")).where(F.col("r.type").isin(lx.RELATION_TYPES))
    return found.select("procedure", F.col("r.source").alias("source_name"), F.col("r.target").alias("target_name"), F.col("r.type").alias("rel_type"), F.lit(None).cast("string").alias("relationship_type"), F.lit("llm_extraction").alias("extraction_method"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("int").alias("sequence_order"))


def co_occurrence(entities: DataFrame, sentences: DataFrame, key: str = "section") -> DataFrame:
    """Pairs of a section's entities (section, ord, name, entity_type) that share a sentence (section, sent, text), the earlier first.

    Names are looked up sentence by sentence in the section's own list, so pairs are made only of names found.
    """
    listed = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "name", "entity_type"))).alias("es"))
    held = sentences.join(listed, key).withColumn("es", F.filter("es", lambda e: F.col("text").contains(e["name"]))).where("size(es) > 1")
    left = held.select(key, "sent", "text", "es", F.posexplode("es").alias("i", "a"))
    pairs = left.select(key, "sent", "text", "a", F.explode(F.expr("slice(es, i + 2, size(es))")).alias("b"))
    return pairs.select(key, "sent", F.col("a.name").alias("source_name"), F.col("b.name").alias("target_name"), pair_type(F.col("a.entity_type"), F.col("b.entity_type"), F.col("text")).alias("rel_type"))


def pair_type(a: Column, b: Column, context: Column) -> Column:
    low, thing, actor = F.lower(context), ["Key", "Parameter"], ["NetworkFunction", "Actor"]
    return (
        F.when((a == "Procedure") | (b == "Procedure"), "PART_OF")
        .when((a.isin(thing) & b.isin(actor)) | (b.isin(thing) & a.isin(actor)), F.when(low.rlike("derive|generate|compute"), "DERIVES").otherwise("USES"))
        .when((a == "Message") | (b == "Message"), F.when(low.rlike("send|transmit|receive"), "SENDS").otherwise("CONTAINS"))
        .when(a.isin(actor) & b.isin(actor), "INTERACTS_WITH").otherwise("RELATED_TO")
    )


def template_pairs(rows: DataFrame, names: str = "names", text: str = "text", key: str = "section", templates: list[tuple[str, str]] = lx.PAIR_TEMPLATES) -> DataFrame:
    """(section, source_name, target_name, rel_type) of two-place templates whose ends are both among the row's names.

    A text is searched once a template; the ends are taken from the short matches. Templates that begin with a word are tried at the
    beginnings of words alone, which is where their first match would be anyway.
    """
    fast = [("(?i)" + (r"(?<!\w)(\w++)" + p[5:] if p.startswith(r"(\w+)\s") else p), t) for p, t in templates]

    def ends(pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("a"), F.regexp_extract(m, pattern, 2).alias("b")))

    hits = F.array(*[F.struct(F.lit(t).alias("rel_type"), ends(p).alias("ends")) for p, t in fast])
    found = rows.select(key, names, F.explode(hits).alias("h")).select(key, names, "h.rel_type", F.explode("h.ends").alias("z"))
    return found.where(F.array_contains(names, F.col("z.a")) & F.array_contains(names, F.col("z.b"))).select(key, F.col("z.a").alias("source_name"), F.col("z.b").alias("target_name"), "rel_type")


def sends(rows: DataFrame, names: str = "names", text: str = "text", key: str = "section") -> DataFrame:
    """Three relations for each "A sends a M to the B" whose ends are both among the row's names."""
    p = F.lit(r"([A-Z0-9/ -]+)\s+sends an?\s+(.+?)\s+to the\s+([A-Z0-9/ -]+)")
    zipped = F.arrays_zip(*[F.regexp_extract_all(F.col(text), p, F.lit(i)).alias(n) for i, n in ((1, "src"), (2, "msg"), (3, "tgt"))])
    hits = rows.where(F.col(text).contains("sends a")).select(key, names, F.explode(zipped).alias("z")).select(key, names, *[F.trim(f"z.{n}").alias(n) for n in ("src", "msg", "tgt")])
    hits = hits.where(F.array_contains(names, F.col("src")) & F.array_contains(names, F.col("tgt")))
    three = F.expr("inline(array(struct(src as source_name, msg as target_name, 'SENDS_TO' as rel_type), struct(msg as source_name, tgt as target_name, 'IS_SENT_TO' as rel_type), struct(msg as source_name, src as target_name, 'SENT_BY' as rel_type)))")
    return hits.select(key, three)


def _found_at(name: str, said: str) -> str:
    """SQL: where ``name`` first stands in ``said`` as a whole word, from 1; 0: nowhere."""
    # the pattern is made anew for each name, so only where the name's letters are
    return rf"if(contains({said}, {name}), regexp_instr({said}, concat('(?U)\\b\\Q', {name}, '\\E\\b')), 0)"


def derives(rows: DataFrame, names: str = "names", text: str = "text", key: str = "section") -> DataFrame:
    """Per sentence with ``derives``, ``derived`` or ``deriving`` (in this case): the nearest name before the verb derives the first after it; the first other name is its source.

    Names count as whole words in the case given, at their first place; the verb is the first of the sentence.
    """
    sents = rows.select(key, names, F.posexplode(F.split(text, "[.\n]")).alias("sent", "s")).where(F.col("s").contains("deriv"))
    sents = sents.withColumn("verb", F.regexp_instr("s", F.lit(r"(?U)\bderiv(?:es|ed|ing)\b"))).where("verb > 0")
    placed = sents.withColumn("es", F.expr(f"filter(transform({names}, x -> struct({_found_at('x', 's')} as pos, x as name)), e -> e.pos > 0)"))
    placed = placed.withColumn("before", F.expr("array_max(filter(es, e -> e.pos < verb))")).withColumn("after", F.expr("array_min(filter(es, e -> e.pos > verb))")).where("before is not null and after is not null")
    placed = placed.withColumn("third", F.expr("array_min(filter(es, e -> e.name <> before.name and e.name <> after.name))"))
    two = F.expr("inline(array(struct(before.name as source_name, after.name as target_name, 'DERIVES' as rel_type), struct(after.name as source_name, third.name as target_name, 'DERIVED_FROM' as rel_type)))")
    return placed.select(key, "sent", two).where("target_name is not null")


def verb_relations(rows: DataFrame, key: str, names: str = "names", tokens: str = "tokens") -> DataFrame:
    """(key, at, source_name, target_name, rel_type, verb, confidence) of each listed verb whose subject and object are both among the row's names.

    tokens: array of struct (i, word, lemma, pos, dep, head) of a dependency parse; ``key`` tells rows apart. Where
    several children qualify, the last one counts; a verb with one thing at both ends gives nothing.
    """
    kinds = {v: t for t, verbs in lx.VERB_RELATIONS.items() for v in verbs}
    verbs = F.filter(tokens, lambda t: (t["pos"] == "VERB") & t["lemma"].isin(list(kinds)))
    ends = F.filter(tokens, lambda t: t["dep"].isin(lx.SUBJECTS + lx.OBJECTS) & F.array_contains(F.col(names), t["word"]))
    heads = rows.select(key, F.map_from_entries(F.transform(verbs, lambda t: F.struct(t["i"], t["lemma"]))).alias("verbs"), F.explode(ends).alias("t"))
    hung = heads.select(key, F.col("t.head").alias("at"), F.try_element_at("verbs", F.col("t.head")).alias("verb"), "t").where("verb is not null")
    last = lambda deps: F.max_by("t.word", F.when(F.col("t.dep").isin(deps), F.col("t.i")))
    both = hung.groupBy(key, "at", "verb").agg(last(lx.SUBJECTS).alias("source_name"), last(lx.OBJECTS).alias("target_name"))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return both.where("source_name <> target_name").select(key, "at", "source_name", "target_name", F.element_at(kind, F.col("verb")).alias("rel_type"), "verb", F.lit(0.8).alias("confidence"))
