from pyspark.sql import functions as F

from fathomweave.operators import build, fsm, search, steps


def test_long_machine_is_reachable(spark):
    n = 500
    made = spark.createDataFrame([("p", f"p_step_{i}", i + 1, i == 0, i == n - 1, "", "Step") for i in range(n)], "procedure string, name string, ord int, is_initial boolean, is_final boolean, description string, entity_type string")
    moves = spark.createDataFrame([("p", f"p_step_{i}", f"p_step_{i + 1}", "t", "", "a") for i in range(n - 1) if i != 300], "procedure string, source_state string, target_state string, trigger string, condition string, action string")
    lost = fsm.violations(made, moves)
    assert sorted(int(r["detail"].rpartition("_")[2]) for r in lost.where("rule = 'unreachable'").collect()) == list(range(301, n))
    assert fsm.reachable_states(made.where("false"), moves).count() == 0


def test_steps_chain(spark):
    rows = [("a", "4.2 Xn - based handover", "1.\tThe UE asks. 2.\tThe AMF answers. 3.\tDone now", ["Step 9: no"], None), ("b", "5G AKA", "none", ["Step 7a: The UE sends", "odd"], None), ("c", "Plain", None, ["first", "second"], None), ("d", "Plain, too", "", [], "1. One\n2. Two"), ("e", "E", "x", [], "all in a line 1. Go 2. Stop"), ("f", "F", "x", [], None)]
    t = spark.createDataFrame(rows, "procedure string, title string, text string, found array<string>, answer string")
    got = {}
    for r in steps.completed(t, found="found", answer="answer").orderBy("procedure", "ord").collect():
        got.setdefault(r["procedure"], []).append((r["name"], r["description"], r["origin"]))
    assert got["a"] == [("42_Xn__based_handover_step_1", "The UE asks.", "text"), ("42_Xn__based_handover_step_2", "The AMF answers.", "text"), ("42_Xn__based_handover_step_3", "Done now", "text")]
    assert got["b"] == [("5G_AKA_step_7a", "The UE sends", "listed")]
    assert got["c"] == [("Plain_step_1", "first", "listed"), ("Plain_step_2", "second", "listed")]
    assert got["d"] == [("Plain_too_step_1", "One", "suggested"), ("Plain_too_step_2", "Two", "suggested")]
    assert [d for _, d, _ in got["e"]] == ["all in a line", "Go", "Stop"] and "f" not in got
    twice = steps.step_entities(steps.parse(spark.createDataFrame([("p", "1. a\n1. b")], "procedure string, text string")), spark.createDataFrame([("p", "T")], "procedure string, title string"))
    assert [(r["name"], r["description"]) for r in twice.collect()] == [("T_step_1", "b")] * 2
    lines = spark.createDataFrame([("intro\n2. go",), ("x\nThe AMF sends a request now",), ("x",), (None,)], "text string")
    assert [r[0] for r in lines.select(steps.start_line(F.col("text"))).collect()][:3] == [1, 1, -1]
    said = spark.createDataFrame([("network_functions: AMF, , SMF\nKEYS:K\nSteps: 1. Ask it|no|2. Answer",)], "a string").select(steps.answer_lists(F.col("a")).alias("x")).first()["x"]
    assert (said["network_functions"], said["keys"], said["messages"], said["steps"]) == (["AMF", "SMF"], ["K"], [], ["1. Ask it", "2. Answer"])


def test_sections_to_graph_and_back(spark, tmp_path):
    sections = spark.createDataFrame([("33501-i60_new", "6.1", "The AMF and the SEAF use 5G AKA with SUCI."), ("33501-i60_new", "6.2", "nothing"), ("33501-i60_new", "6.3", None)], "document string, clause string, text string")
    nodes, edges = build.graph_of_sections(sections)
    assert {(r["name"], r["entity_type"]) for r in nodes.collect()} == {("AMF", "NetworkFunction"), ("SEAF", "NetworkFunction"), ("5G AKA", "Procedure"), ("SUCI", "Parameter"), ("33501-i60", "Specification")}
    assert nodes.where("entity_type = 'Specification'").first()["properties"] == {"document": "TS 33501", "version": "i60"}
    assert {tuple(r) for r in edges.collect()} == {("5G AKA", "SUCI", "CONTAINS"), ("AMF", "5G AKA", "PART_OF"), ("SEAF", "5G AKA", "PART_OF"), ("SUCI", "5G AKA", "PART_OF")}
    folder = str(tmp_path / "graph")
    rich = nodes.withColumn("seq", F.lit(1)).unionByName(spark.createDataFrame([("AMF", "NetworkFunction", {"k": "v"}, 2), ("p_step_10", "Step", {"procedure": "p"}, 3), ("p_step_2", "Step", {"procedure": "p"}, 4)], "name string, entity_type string, properties map<string,string>, seq int"))
    more = edges.withColumn("properties", F.create_map(F.lit("a"), F.lit("b"))).withColumn("seq", F.lit(1))
    assert not build.write_graph(rich.where("false"), more, folder) and build.write_graph(rich, more, folder)
    back, links = build.read_graph(spark, folder)
    assert back.count() == 7 and links.count() == 4 and back.where("name = 'AMF'").first()["properties"] == {"k": "v"}
    assert [r["name"] for r in build.steps_of(back, "p").collect()] == ["p_step_2", "p_step_10"]
    assert build.touching(links, spark.createDataFrame([("5G AKA",), ("SUCI",)], "name string")).count() == 4
    own = spark.createDataFrame([("AMF", "msg", "SENDS", {"x": "1"}, "p")], "source_name string, target_name string, rel_type string, properties map<string,string>, procedure string")
    got = build.scoped(own).first()
    assert (got["source_name"], got["target_name"], got["properties"]) == ("p_AMF", "msg", {"x": "1", "procedure": "p"})
    third = spark.createDataFrame([(["a", "b", "c"], "a", "b"), (["a", "b"], "a", "b")], "n array<string>, s string, k string").select(build.third_party(F.col("n"), F.col("s"), F.col("k")))
    assert [r[0] for r in third.collect()] == ["c", None]


def test_lists_beside_the_procedure(spark):
    t = spark.createDataFrame([("p", "The UE sends a Registration Request to the AMF", ["amf", "none"], ["Registration Request"])], "name string, text string, nf array<string>, msg array<string>")
    none = F.array().cast("array<string>")
    t = t.withColumn("names", F.struct(F.col("nf").alias("network_functions"), none.alias("parameters"), none.alias("keys"), F.col("msg").alias("messages"), F.array(F.lit("s")).alias("steps")))
    got = build.with_entities(t.withColumn("names", build.validated(F.col("names"), F.col("text"), F.col("text")))).first()
    assert (got["network_functions"], got["messages"], got["parameters"], got["keys"], got["steps"]) == (["AMF"], ["Registration Request"], [], [], ["s"])


def test_presets_and_details(spark):
    v = lambda x: [x, 1.0 - x]
    rows = [("P one", "Procedure", v(1.0), None, {}, 1), ("P-two", "Procedure", v(0.0), "d", {}, 2), ("P_s_1", "Step", v(1.0), "does", {"procedure": "P one"}, 3)]
    nodes = spark.createDataFrame(rows, "name string, entity_type string, embedding array<double>, description string, properties map<string,string>, seq int").withColumn("title_embedding", F.col("embedding")).withColumn("parent_embedding", F.col("embedding"))
    assert [r["name"] for r in search.search_procedures(nodes, v(1.0)).collect()] == ["P one"]
    assert [r["name"] for r in search.by_description(nodes, v(0.5)).collect()] == ["P one", "P-two"]
    assert search.authentication_procedures(nodes, lambda text: v(0.0) if "5G core" in text else v(1.0)).first()["name"] == "P-two"
    assert search.all_entities(nodes).count() == 3
    edges = spark.createDataFrame([("P one", "AMF", "USES"), ("x", "y", "USES")], "source_name string, target_name string, rel_type string")
    got = {r["name"]: r for r in search.procedure_details(nodes, edges, nodes.select("name")).collect()}
    assert [s["name"] for s in got["P one"]["steps"]] == ["P_s_1"] and len(got["P one"]["relationships"]) == 1
    assert [tuple(s) for s in got["P-two"]["steps"]][0] == ("P_two_step_1", "Execute step 1 of P-two") and set(got) == {"P one", "P-two"}
    queries = spark.createDataFrame([(1, v(1.0)), (2, v(0.0))], "query_id int, q array<double>")
    drawn = search.demonstration(nodes.withColumn("vec_id", F.col("seq")), queries, 2).where("drawn").collect()
    assert {(r["query_id"], r["vec_id"]) for r in drawn} == {(1, 1), (2, 2)}


def test_names_of_sections_are_found_once(spark):
    """What edges and nodes ask of the names is read from a table, not searched for in the texts again; prefilters lose no relation."""
    text = "AMF sends a Paging to the UE. The AMF sends an  SUCI to the SEAF. xAMF derives KAUSF\nThe AMF derives KAUSF from AUTN. deriving"
    rows = spark.createDataFrame([("d", "1", text), ("d", "2", None), (None, "3", text)], "document string, clause string, text string")
    entities, edges = build.from_sections(rows)
    for made in (entities, edges):
        assert "(?i)" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r)[1:] for r in edges.where("rel_type in ('SENDS_TO', 'DERIVES', 'DERIVED_FROM')").collect()}
    assert {("1", "AMF", "Paging", "SENDS_TO"), ("1", "AMF", "KAUSF", "DERIVES"), ("1", "KAUSF", "AUTN", "DERIVED_FROM")} <= got
