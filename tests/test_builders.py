import warnings

import pytest
from pyspark.sql import functions as F

from fathomweave.functions import annotate
from fathomweave.functions import lexicon as lx
from fathomweave.operators import classify, evidence, extract, relate, requirements

VERBS = [v for vs in lx.VERB_RELATIONS.values() for v in vs]


def test_requirement_graph(spark):
    rows = [(1, "T", "The key hierarchy of a very long and new network function is shown. Key hierarchy", "/a/b/spec.docx"), (2, "T", None, "spec.docx"), (3, None, "", None)]
    done = requirements.processed(spark.createDataFrame(rows, "id int, title string, text string, source string"))
    got = {r["id"]: r for r in done.collect()}
    assert got[1]["entities"] == ["key hierarchy", "very long", "new network function", "shown", "Key hierarchy"] and got[1]["source"] == "spec.docx"
    assert got[2]["entities"] is None and got[2]["embedding"] is None and got[3]["entities"] == []
    nodes, edges = requirements.requirement_graph(done, "id")
    kinds = [r["entity_type"] for r in nodes.collect()]
    assert (kinds.count("Requirement"), kinds.count("Document"), kinds.count("Entity")) == (3, 1, 5)
    assert edges.where("rel_type = 'PART_OF'").count() == 2 and edges.where("rel_type = 'CONTAINS_ENTITY'").count() == 5
    chunked = requirements.processed(spark.createDataFrame([(1, "", "x", "s")], "id int, title string, text string, source string"), F.array(F.lit("one two three four"), F.lit("one"), F.lit("one"), F.lit("")))
    assert chunked.first()["entities"] == ["one"]


def test_verb_relations_of_the_stand_in_parser(spark):
    rows = [(1, "The UE sends it to AMF. AMF derives KAMF from KSEAF. UE walks. AMF verified AMF"), (2, ""), (3, None)]
    parsed = annotate.parse(spark.createDataFrame(rows, "id int, text string"), "text", "tokens", VERBS)
    got = relate.verb_relations(parsed.withColumn("names", F.array(*map(F.lit, ["UE", "AMF", "KAMF"]))), "id").collect()
    assert {(r["id"], r["source_name"], r["target_name"], r["rel_type"], r["verb"]) for r in got} == {(1, "UE", "AMF", "COMMUNICATES_WITH", "send"), (1, "AMF", "KAMF", "DERIVES", "derive")}


def test_last_child_counts(spark):
    kind = "id int, tokens array<struct<i int, word string, lemma string, pos string, dep string, head int>>, names array<string>"
    t = [(0, "A", "a", "N", "nsubj", 2), (1, "B", "b", "N", "nsubjpass", 2), (2, "s", "send", "VERB", "ROOT", 2), (3, "C", "c", "N", "dobj", 2), (4, "D", "d", "N", "attr", 2), (5, "E", "e", "N", "dobj", 2)]
    got = relate.verb_relations(spark.createDataFrame([(1, t, ["A", "B", "C", "D"]), (2, t, ["A", "C", "E"]), (3, t, ["A"]), (4, None, ["A"])], kind), "id").collect()
    assert {(r["id"], r["source_name"], r["target_name"]) for r in got} == {(1, "B", "D"), (2, "A", "E")}


def test_recogniser(spark):
    text = "x" * 505 + " AMF and RES* " + "the parameter XRES* " + "y" * 500 + " KAMF UDM UE request"
    s = spark.createDataFrame([(1, text), (2, "AMF"), (3, None), (4, "")], "section int, text string")
    cut = extract.pieces(s)
    assert [(r["section"], r["piece"], len(r["context"])) for r in cut.orderBy("section", "piece").collect()] == [(1, 0, 512), (1, 1, 512), (1, 2, len(text) - 1024)]
    got = {r["name"]: r["entity_type"] for r in extract.from_recogniser(annotate.recognise(cut, "context", "hits")).collect()}
    assert got["AMF"] == "NetworkFunction" and got["XRES*"] == "Key" and got["KAMF"] == "Message" and "UE" not in got
    low = cut.withColumn("hits", F.expr("array(struct('Name' as word, 0.8D as score), struct(' Other ' as word, 0.9D as score), struct('ab' as word, 1D as score))"))
    assert {r["name"] for r in extract.from_recogniser(low).collect()} == {"Other"}
    assert [r["section"] for r in extract.substantial(s).collect()] == [1]


def test_continuation(spark):
    lines = [("1. The UE", False), ("7a. x yz", False), ("step 3 of it", False), ("ab", True), (None, True), ("This is it.", True), ("However the AMF", False), ("The AMF sends it.", True), ("it " + "x" * 120, False), ("after that " + "x" * 120, True), ("A plain line", False)]
    df = spark.createDataFrame(lines, "line string, want boolean").withColumn("got", evidence.is_continuation(F.col("line")))
    assert all(r["got"] == r["want"] for r in df.collect())
    alike = spark.createDataFrame([("A plain line", 0.71), ("A plain line", 0.7), ("A plain line", None), ("1. step", 0.9)], "line string, c double")
    assert [r[0] for r in alike.select(evidence.is_continuation(F.col("line"), F.col("c"))).collect()] == [True, False, False, False]


def test_ordered_fallbacks(spark):
    def broken():
        raise OSError("no weights")

    load = annotate.first_available([broken, lambda: lambda ts: 1 // 0, lambda: lambda ts: [[1.0, 2.0] for _ in ts]], ["probe"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert load()(["x"]) == [[1.0, 2.0]]
        with pytest.raises(RuntimeError):
            annotate.first_available([broken], ["probe"])()


def test_sections_of_one_document(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "document string, n int")
    assert [r["n"] for r in classify.of_document(s, "a").collect()] == [1]


def test_noun_phrases_are_found_once(spark):
    """The planner adds no second search for them, and cut words in any case, between marks or at an end, part them."""
    rows = spark.createDataFrame([(1, "t", "The AMF OF the UE, not|THE Key of", "a/s"), (2, "t", None, "s"), (3, "t", "", None), (4, "t", "of the", "s")], "id int, title string, text string, source string")
    edges = requirements.contains_entity(requirements.processed(rows), "id")
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1
    assert sorted((r["source_name"], r["target_name"]) for r in edges.collect()) == [("1", "AMF"), ("1", "Key"), ("1", "UE")]
