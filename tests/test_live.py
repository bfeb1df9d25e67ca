import json

from pyspark.sql import functions as F

from fathomweave.functions import annotate
from fathomweave.operators import live
from tests.oracle import SF

SCHEMA = "document string, doc_seq int, section_seq bigint, title string, clause string, text string, figures array<string>, has_figure boolean"
FILLER = " The network checks what it was given." * 20
AUTH = (
    "The AMF and the AUSF authenticate the UE with the UDM." + FILLER + "\n1.\tThe UE sends a Registration Request with the SUCI to the AMF."
    "\n2.\tThe AMF forwards it to the AUSF.\n3.\tThe AUSF derives Kseaf and sends the Authentication Response to the AMF."
)


def made(spark):
    rows = [
        ("a", 0, 1, "6.1 Security", "6.1", "Nothing here.", [], False),
        ("a", 0, 2, "6.1.3 Authentication procedure", "6.1.3", AUTH, ["Figure 6.1.3-1"], True),
        ("a", 0, 3, "6.1.4 Overview", "6.1.4", "short", ["Figure 6.1.4-1"], True),
        ("b", 1, 1, "5 Registration procedure", "5", None, ["Figure 5-1"], True),
        ("b", 1, 2, "5.2 Registration update procedure", "5.2", "The amf, smf, upf and ue move." + FILLER, ["Figure 5.2-1"], True),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_from_sections_to_a_stored_graph(spark, tmp_path):
    nodes, edges = live.build_graph(made(spark), str(tmp_path / "g"), buckets=4)
    got = {(r["name"], r["entity_type"]): r for r in nodes.collect()}
    name = "6.1.3 Authentication procedure"
    assert {t for _, t in got} == {"Procedure", "NetworkFunction", "Message", "Parameter", "Key", "Step"}
    one = got[name, "Procedure"]
    assert one["parent_title"] == "6.1 Security" and one["description"].startswith("Parent Section: 6.1 Security. Procedure: ") and "Steps: The UE sends" in one["description"]
    assert one["properties"]["document"] == "a" and len(one["embedding"]) == len(one["parent_title_embedding"]) == 64
    steps = sorted((n for n, t in got if t == "Step"), key=str)
    assert steps == [f"613_Authentication_procedure_step_{i}" for i in (1, 2, 3)]
    assert got[steps[0], "Step"]["properties"]["step_number"] == "1" and got[steps[0], "Step"]["parent_title_embedding"] is None
    functions = {n for n, t in got if t == "NetworkFunction"}
    assert {"AMF", "AUSF", "UE"} <= functions and got["AMF", "NetworkFunction"]["embedding"] is None and got["AMF", "NetworkFunction"]["title_embedding"] is not None
    assert got["KSEAF", "Key"]["properties"] == {"procedure": name, "clause": "6.1.3"}
    rels = {(r["source_name"], r["target_name"], r["rel_type"]) for r in edges.collect()}
    assert (steps[0], steps[1], "FOLLOWED_BY") in rels and (name, "AMF", "INVOKE") in rels and (steps[0], "SUCI", "CONTAINS") in rels
    assert {x for s, t, _ in rels for x in (s, t)} <= {n for n, _ in got}
    assert "5 Registration procedure" not in {n for n, _ in got}
    # the same sections again change nothing
    key = lambda a, b: (sorted(map(repr, a.collect())), sorted(map(repr, b.collect())))
    before = key(nodes, edges)
    assert key(*live.build_graph(made(spark), str(tmp_path / "g"))) == before
    # documents one by one give what all together give
    for d in ("b", "a", "b"):
        live.build_graph(made(spark).where(F.col("document") == d), str(tmp_path / "h"), buckets=4)
    assert live.counts(*live.read_graph(spark, str(tmp_path / "h"))).orderBy("what", "kind").collect() == live.counts(nodes, edges).orderBy("what", "kind").collect()


def test_nothing_to_build(spark, tmp_path):
    nodes, edges = live.build_graph(made(spark).where("false"), str(tmp_path / "g"))
    assert nodes.count() == edges.count() == 0


def test_query(spark):
    from fathomweave.plans import catalogue

    got = {(r["what"], r["kind"]): r["n"] for r in catalogue.QUERIES["live_build"](spark, SF).collect()}
    assert got["node", "Procedure"] > 0 and got["edge", "PART_OF"] == got["node", "Step"] > 0


V3 = "document string, doc_seq int, section_seq int, title string, clause string, text string"


def test_recognised_graph(spark, tmp_path):
    long = " Nothing of note is said in this part of the section."
    rows = [
        ("a", 0, 1, "Introduction", "0", "The AMF sends SUPI to UDM. The AUSF verifies SUPI." + long),
        ("a", 0, 2, "1 Scope", "1", "amf and registration procedure. AMF derives K_AMF." + long),
        ("b", 1, 1, "2 Short", "2", "The SMF rests."),
        ("c", 2, 1, "3 None", "3", None),
    ]
    found = spark.createDataFrame(rows, V3)
    labelled = lambda df: df.select("section", F.lit(0).alias("pos"), F.lit("Acme Corp").alias("word"), F.lit("ORG").alias("label")).where("section like '%#a#%'")
    nodes, edges = live.recognised_graph(found, str(tmp_path / "g"), labelled=labelled, buckets=4)
    got = {(r["name"], r["entity_type"]): r["properties"] for r in nodes.collect()}
    assert ("AMF", "NetworkFunction") in got and ("Acme Corp", "Actor") in got and ("SMF", "NetworkFunction") not in got
    # a recogniser's hit comes before the known list, and the first section counts
    assert got["AMF", "NetworkFunction"] == {"discovery_method": "recogniser", "source_clause": "0", "source_section": "Introduction"}
    assert got["Acme Corp", "Actor"]["discovery_method"] == "parser"
    rels = {(r["source_name"], r["target_name"], r["rel_type"]): r["properties"] for r in edges.collect()}
    assert rels["AMF", "UDM", "SENDS_TO"] == {"method": "template", "confidence": "0.7"}
    assert rels["AMF", "SUPI", "COMMUNICATES_WITH"]["verb"] == "send" and rels["AUSF", "SUPI", "AUTHENTICATES"] == {"confidence": "0.7", "method": "template"}
    assert rels["AMF", "UDM", "INTERACTS_WITH"] == {"confidence": "0.6", "method": "cooccurrence"}
    key = lambda a, b: (sorted(map(repr, a.collect())), sorted(map(repr, b.collect())))
    before = key(nodes, edges)
    assert key(*live.recognised_graph(found, str(tmp_path / "g"), labelled=labelled)) == before
    for d in ("c", "b", "a"):
        live.recognised_graph(found.where(F.col("document") == d), str(tmp_path / "h"), labelled=labelled, buckets=2)
    assert live.counts(*(live.store.read(spark, str(tmp_path / "h" / x)) for x in ("nodes", "edges"))).count() == live.counts(nodes, edges).count()


def test_requirement_graph(spark, tmp_path):
    rows = [("d", 0, i, s, t) for i, (s, t) in enumerate([("Heading 1", "1 Scope"), ("Normal", "the secure channel protects long term keys"), ("Heading 2", "2 Empty"), ("Heading 3", "3 More"), ("Normal", "a secure channel")])]
    p = spark.createDataFrame(rows, "document string, doc_seq int, para_seq int, style string, text string")
    nodes, edges = live.requirement_graph(p, str(tmp_path / "g"), buckets=2)
    got = {(r["name"], r["entity_type"]): r for r in nodes.collect()}
    assert [t for _, t in got].count("Requirement") == 2 and ("d.docx", "Document") in got and ("secure channel", "Entity") in got
    assert all((r["embedding"] is not None) == (t == "Requirement") for (_, t), r in got.items())
    assert edges.where("target_name = 'secure channel' and rel_type = 'CONTAINS_ENTITY'").count() == 1


def test_demonstration_draws_the_best(spark, tmp_path):
    nodes, edges = live.build_graph(made(spark), str(tmp_path / "g"), buckets=2)
    said = [(1, "authentication procedure of the UE with the AUSF"), (2, "registration update"), (3, "zzz")]
    queries = annotate.embed(spark.createDataFrame(said, "query_id int, text string"), "text", "q").select("query_id", "q")
    got = live.demonstrate(nodes, edges, queries, str(tmp_path / "out")).collect()
    best = {r["query_id"]: r for r in got if r["rank"] == 1}
    name = "6.1.3 Authentication procedure"
    assert best[1]["procedure"] == name and (best[1]["states"], best[1]["errors"]) == (3, 0) and best[1]["transitions"] >= 2
    assert best[1]["files"] == [f"{name}_fsm.dot", f"{name}_fsm.json"]
    drawn = json.loads((tmp_path / "out" / f"{name}_fsm.json").read_text())
    assert drawn["procedure_name"] == name and len(drawn["states"]) == 3
    assert all(r["states"] is None for r in got if r["rank"] > 1)
    # a procedure without steps has no machine
    assert all((r["files"] is None) == (r["procedure"] != name) for r in best.values()) and len([r for r in got if r["query_id"] == 1]) == 2


def test_steps_in_rows_are_those_of_the_joins(spark):
    many = "\n".join(f"{i}. The AMF says {i}." for i in range(12, 0, -1))
    texts = [many, "1. a b\n1. c d\nmore of it\n2. e", "intro\n7-12b. x y\n3(A). z\n\n 99999999999. far", "no steps", "", None, "1.\tFirst one. 2.\tThe second 2a.\tThird"]
    rows = [(str(i), f"6.{i} Some, title" if i % 2 else "Flow é", t, "1. say so\n2. Step 4: and so" if i % 3 else "Step 2: yes\nnothing") for i, t in enumerate(texts)] + [("x", None, "1. one", None)]
    p = spark.createDataFrame(rows, "procedure string, title string, text string, answer string").coalesce(1)
    for answer in (None, "answer"):
        joined = live.steps.completed(p, "procedure", "title", "text", None, answer)
        want = sorted((r["procedure"], r["ord"], r["name"], r["description"]) for r in joined.collect())
        got = live.steps.in_rows(p, "title", "text", answer).select("procedure", F.explode("steps").alias("s")).select("procedure", "s.ord", "s.name", "s.description")
        assert sorted(map(tuple, got.collect())) == want and len(want) > 15
    assert "Aggregate" not in live.procedures(made(spark))._jdf.queryExecution().optimizedPlan().toString()


def test_small_shares_give_the_same_graph(spark, tmp_path, monkeypatch):
    key = lambda a, b: (sorted(map(repr, a.collect())), sorted(map(repr, b.collect())))
    before = key(*live.build_graph(made(spark), str(tmp_path / "g"), buckets=2))
    monkeypatch.setattr(live.store, "PER_TASK", 5)
    assert key(*live.build_graph(made(spark), str(tmp_path / "h"), buckets=2)) == before
    monkeypatch.setattr(live.store, "LEAST_ROWS", 1)
    monkeypatch.setattr(live.store, "CROWDED", 0)
    assert key(*live.build_graph(made(spark), str(tmp_path / "i"), buckets=2)) == before


def test_vectors_of_many_texts_are_those_of_one(spark):
    texts = ["", "Aa a_1 b-B\tç", "plain words, 5G-AKA' and x_y.", "x" * 63 + " " + "y" * 64 + " " + "z" * 65 + " " + "y" * 300, "İK K ß é", "...", "one"]
    places = annotate._Places(64)
    for some in (texts, texts[2:4], texts[:1], texts[4:5]):
        assert annotate.hashed_vectors(some, places).tolist() == [annotate.hashed_vector(t) for t in some]
    rows = [(i, t) for i, t in enumerate([*texts, None, " " * 17000, "a b. " * 4000])]
    got = {r["id"]: r["v"] for r in annotate.embed(spark.createDataFrame(rows, "id int, text string").coalesce(1), "text", "v").collect()}
    # a long text of blanks alone has no parts
    assert got[len(texts)] is None and got[len(texts) + 1] == [0.0] * 64 and len(got[len(texts) + 2]) == 64
    assert all(abs(a - b) < 1e-6 for i, t in enumerate(texts) for a, b in zip(got[i], annotate.hashed_vector(t), strict=True))


def test_words_are_found_as_by_their_patterns_alone(spark):
    words = ["UE", "XRES*", "EAP-AKA'", "PDU Session ID", "Kc", "K_enb*", "é", "ÉA", "**", "5G-GUTI", "SD"]
    texts = [*words, None, "", "KUE", "UEK", "İ ue", "Kc kc", "éUE", "UE_1", "the ue, pdu session id", "pdu session  id", "xres*s k_ENB*1", "eap-aka'x", "5g-guti.SD", "١UE ªsd", "úe UÉ"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    for strict in (False, True):
        for plain in (False, True):
            mark = lambda w: (r"(?<!\w)%s(?!\w)" if strict else r"\b%s\b") % live.tx.literal(w)
            want = F.array_compact(F.array(*[F.when(F.col("t").rlike(("(?i)" if plain else "") + mark(w)), F.lit(w)) for w in words]))
            got = t.select("t", live.extract.matches(F.col("t"), words, strict, plain).alias("got"), want.alias("want")).collect()
            assert [r for r in got if r["got"] != r["want"]] == [] and any(r["got"] for r in got)
    runs = {r["t"]: r["x"] for r in t.select("t", live.extract.runs_in(F.col("t"), ["UE", "PDU Session ID", "SD"]).alias("x")).collect()}
    # what is not among them is not looked for
    assert runs["éUE"] == ["ue"] and runs["UE_1"] == [] and sorted(runs["the ue, pdu session id"]) == ["id", "pdu", "session", "ue"]


def test_what_a_model_has_named_is_not_scored(spark):
    rows = live.classify.identify(made(spark), F.when(F.col("section_seq") == 3, F.lit("Named")))
    got = {(r["document"], r["section_seq"]): r for r in rows.collect()}
    assert got["a", 3]["procedure_name"] == "Named" and got["a", 3]["text"] == "short" and got["a", 3]["step_count"] is None
    assert got["a", 2]["procedure_name"] == "6.1.3 Authentication procedure" and got["a", 2]["step_count"] is not None


def test_edges_are_looked_for_once_and_carry_one_step(spark, tmp_path, monkeypatch):
    twice, merge = {}, live.store.merge

    def noted(batch, path, *a, **b):
        twice[path.rsplit("/", 1)[-1]] = b.get("within") is not None
        return merge(batch, path, *a, **b)

    monkeypatch.setattr(live.store, "merge", noted)
    live.build_graph(made(spark), str(tmp_path / "g"), buckets=2)
    assert twice["edges"] is False
    rows = live.relate.followed_by(live.procedures(made(spark)))
    assert [(r["source_name"][-1], r["target_name"][-1], r["sequence_order"]) for r in rows.orderBy("sequence_order").collect()] == [("1", "2", 1), ("2", "3", 2)]
    assert "posexplode" not in rows._jdf.queryExecution().analyzed().toString()
