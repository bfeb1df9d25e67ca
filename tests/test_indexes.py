import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fathomweave.operators import extract, graph, name_index, phrases
from tests.oracle import SF


@pytest.mark.parametrize("held", [phrases.HELD, 0])
def test_phrases_equal_matches(spark, held):
    r = random.Random(1)
    words = ["AMF", "5G-AKA", "PDU Session ID", "pdu", "UE", "EAP", "Ü-x", "x_1", "a.b", "Session", "amf"]
    texts = [(i, r.choice(["", " ", "-"]).join(r.choice([*words, "amf", "PDU session id", "5g-aka", ",", " ", "AMFs", "_UE", "é", "\n"]) for _ in range(30))) for i in range(200)] + [(200, None), (201, ""), (3, "AMF AMF amf")]
    t = spark.createDataFrame(texts, "id int, text string")
    lex = spark.createDataFrame([(w,) for w in [*words, "AMF", None, "RES*", ""]], "phrase string")
    got = sorted(tuple(x) for x in phrases.hits(t, lex, "id", held=held).collect())
    want = sorted((i, w, m.start() + 1) for i, text in texts for w in set(words) for m in re.finditer(rf"(?<!\w)(?={re.escape(w)}(?!\w))", text or "", re.I))
    assert got == want
    plain = t.where("id < 200").select("id", F.explode(extract.matches(F.col("text"), sorted(set(words)))).alias("phrase")).collect()
    assert {(i, w) for i, w, _ in got if i < 200} >= {(r["id"], r["phrase"]) for r in plain if r["phrase"].isascii()}


def test_time_does_not_depend_on_the_number_of_phrases(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = d.select(F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[^\p{L} ]", ""), " "))).alias("phrase")).where("length(phrase) > 3").distinct()
    many = words.limit(20000).union(spark.range(80000).select(F.concat(F.lit("no such phrase "), F.col("id"))))
    took = []
    for lex in (words.limit(50), words.limit(50), many):
        began = time.time()
        phrases.hits(d, lex, "doc_id").write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[2] < 6 * took[1] + 10


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(2)
    nodes = spark.createDataFrame([(f"n{r.randint(0, 60)}", i) for i in range(90)], "name string, node_id int")
    edges = spark.createDataFrame([(f"n{r.randint(0, 70)}", f"n{r.randint(0, 70)}", "R", i) for i in range(300)], "source_name string, target_name string, rel_type string, ord int")
    folder = str(tmp_path_factory.mktemp("index"))
    name_index.write(nodes, edges, "g", folder, 4)
    yield nodes, edges, folder
    for part in ("nodes", "from", "to"):
        spark.sql(f"drop table if exists g_{part}")


def test_joins_of_ends_need_no_shuffle(spark, indexed):
    nodes, edges, folder = indexed
    for df in (name_index.ends(spark, "g", "from"), name_index.ends(spark, "g", "to"), name_index.missing_ends(spark, "g")):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = sorted((x["ord"], x["source_id"], x["target_id"]) for x in graph.resolve(edges, nodes).collect())
    a, b = name_index.ends(spark, "g", "from"), name_index.ends(spark, "g", "to")
    both = a.select("ord", F.col("node.node_id").alias("source_id")).join(b.select("ord", F.col("node.node_id").alias("target_id")), "ord")
    assert sorted(map(tuple, both.collect())) == want
    key = lambda df: sorted((x["ord"], x["missing"]) for x in df.collect())
    assert key(name_index.missing_ends(spark, "g")) == key(graph.missing_ends(edges, nodes))


def test_look_ups_read_one_bucket(spark, indexed):
    nodes, edges, folder = indexed
    found = name_index.find(spark, "g", "n7")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, nodes.where("name = 'n7'").collect()))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't say so
    try:
        assert "SelectedBucketsCount: 1 out of 4" in name_index.find(spark, "g", "n7")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert name_index.around(spark, "g", "n7").count() == edges.where("source_name = 'n7' or target_name = 'n7'").count()
    other = spark.newSession()
    spark.sql("drop table g_from")
    name_index.open_index(other, "g", folder, 4)
    df = name_index.ends(other, "g", "from")
    assert df.count() == edges.join(nodes, F.col("source_name") == F.col("name")).count() and "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_suggestions(spark, tmp_path):
    r = random.Random(4)
    rows = [("".join(r.choice("abcÄ_ 1") for _ in range(r.randint(1, 9))), ["".join(r.choice("abcä") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 3))]) for _ in range(300)] + [("", ["a"]), (None, ["b"]), ("xyz", None)]
    nodes = spark.createDataFrame(rows, "name string, keywords array<string>")
    folder = str(tmp_path / "letters")
    name_index.write_letters(nodes, folder)
    for q in ["a", "AB", "abc", "bca1", "c_ 1", "ä", "aaaaa", "", "zz", "abcabcabc", "yz"]:
        got = [x["name"] for x in name_index.suggest(spark, folder, q, 1000).collect()]
        assert got == [x["name"] for x in graph.suggest(nodes.where("name is not null"), q, 1000).collect()], q
    plan = name_index.suggest(spark, folder, "bca")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in text and "PushedFilters: [IsNotNull(gram), GreaterThanOrEqual(gram,bca)" in text
