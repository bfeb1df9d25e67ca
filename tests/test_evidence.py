import json

from pyspark.sql import functions as F

from fathomweave.operators import evidence as ev
from fathomweave.operators import extract, graph, sinks


def test_directions(spark):
    rows = [("Nausf_UEAuthentication_Authenticate Request", ["AMF", "AUSF"], "x", "AMF", "AUSF"), ("Nausf_UEAuthentication_Authenticate Response", ["AMF", "AUSF"], "x", "AUSF", "AMF"), ("Identity Request", ["SEAF", "UE", "UDM"], "x", "UE", "UDM"), ("Identity Response", ["SEAF", "GW"], "x", "GW", "SEAF"), ("Hello", ["AUSF", "AMF"], "5G authentication", "AMF", "AUSF"), ("Hello", ["AMF"], "registration", None, "AMF"), ("Hello", ["X"], "y", "X", None), ("Hello", [], "y", None, None)]
    df = spark.createDataFrame(rows, "m string, f array<string>, p string, s string, r string")
    for r in df.select("*", ev.message_direction(F.col("m"), F.col("f"), F.col("p")).alias("d")).collect():
        assert (r["d"]["sender"], r["d"]["receiver"]) == (r["s"], r["r"]), r


def test_filters(spark):
    df = spark.createDataFrame([("The AMF shall forward it. See clause 5: SMF sends. UDM rests", ["AMF", "SMF", "UDM", "UPF"], ["UPF stores data"])], "t string, f array<string>, d array<string>")
    assert df.select(ev.involved_functions(F.col("f"), F.col("d"), F.col("t"))).first()[0] == ["AMF", "UPF"]
    assert df.select(ev.search_tags(F.lit("UE Registration"), F.col("f"))).first()[0] == sorted({"ue", "registration", "amf", "smf", "udm", "upf", "attachment", "subscription", "identity", "5g", "3gpp", "core", "network"})
    d = spark.createDataFrame([("The UE sends a request to the network",), ("Figure shows the UE that sends",), ("short",)], "c string")
    assert [r[0] for r in d.select(ev.is_step_description(F.col("c"))).collect()] == [True, False, False]
    assert df.select(ev.mentions_both(F.col("t"), F.lit("amf"), F.lit("forward")), ev.mentions_both(F.col("t"), F.lit("amf"), F.lit("udm"))).first() == (True, False)


def test_validators(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert f(extract.valid_functions(arr("amf", "N2-SMF", "xyz"), F.lit("the AMF acts"))) == ["AMF"]
    assert f(extract.valid_functions(arr("amf", "N2-SMF"), F.lit(""))) == ["AMF", "SMF"]
    assert f(extract.valid_parameters(arr("suci", "NEWP", "zz"), F.lit("The NEWP parameter. zz"))) == ["NEWP", "SUCI"]
    assert f(extract.valid_keys(arr("kausf", "K_new", "abc"), F.lit("a key"))) == ["KAUSF", "K_new"]
    assert f(extract.valid_messages(arr("Service Request", "Foo Command", "odd"), F.lit("they send"))) == ["Foo Command", "Service Request"]
    assert f(extract.matches(F.lit("XRES* and RAND"), ["XRES*", "RAND"])) == ["RAND"] and f(extract.matches(F.lit("XRES* and RAND"), ["XRES*", "RAND"], strict=True)) == ["XRES*", "RAND"]
    assert f(extract.least_entities(F.lit("5G AKA")))["keys"] == ["5G-AKA", "Kausf"]
    assert f(extract.merged(arr("UE", "AMF", "value"), arr("AMF", "SMF"))) == ["AMF", "SMF"]


def test_sinks_and_tables(spark, tmp_path):
    p = spark.createDataFrame([("2", "b"), ("1", "a")], "num string, payload string")
    assert [x["num"] for x in json.loads(sinks.packet_envelope(p).first()["json"])["packets"]] == ["1", "2"]
    sinks.write_packets(p, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 2 and sinks.preview(p, 1).first()["num"] == "1"
    sinks.write_machines(spark.createDataFrame([("a/b", "{}")], "procedure string, json string"), "json", str(tmp_path / "m"))
    assert (tmp_path / "m" / "a_b.json").read_text() == "{}"
    nodes = spark.createDataFrame([("x", "T", {"procedure": "p"}, 1), ("y", "T", {}, 2)], "name string, entity_type string, properties map<string,string>, node_id int")
    edges = spark.createDataFrame([("x", "y", "A B", {"k": "1"}, 1), ("x", "z", "C", {"k": "2"}, 2), ("y", "y", "C", {}, 3)], "source_name string, target_name string, rel_type string, properties map<string,string>, seq int")
    assert graph.resolve(edges, nodes).select("rel_type").orderBy("rel_type").collect()[0][0] == "A_B" and graph.missing_ends(edges, nodes).count() == 1
    graph.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 2
    kept, left = graph.clear_procedure(nodes, edges, "p")
    assert kept.count() == 1 and [r["source_name"] for r in left.collect()] == ["y"]
    assert {r["name"]: r["degree"] for r in graph.degrees(edges, nodes).collect()} == {"x": 2, "y": 2}
