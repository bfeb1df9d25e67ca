"""Small operators that no registered query runs."""

import json

from pyspark.sql import functions as F

from fathomweave.functions import vectors as vx
from fathomweave.operators import evidence, extract, fsm, packets, sinks


def test_one_file_a_machine(spark, tmp_path):
    steps = spark.createDataFrame([("a/b", f"p_step_{i}", f"d{i}", "Step") for i in range(1, 13)] + [("a_b", "q_step_1", "é", "Step"), ("c", "r_step_1", None, "Step")], "procedure string, name string, description string, entity_type string")
    sends = spark.createDataFrame([("a/b", "p_step_2", "Service Request", 0), ("a/b", "p_step_10", "Other", 1)], "procedure string, source_name string, target_name string, ord int")
    made, moves = fsm.states(steps), fsm.transitions(steps, sends)
    folder = str(tmp_path / "m")
    got = sinks.write_machines(fsm.to_json(made, moves), "json", folder)
    # two names that become one share a file
    assert sorted(r["file"] for r in got.collect()) == ["a_b.json", "c.json"] == sorted(p.name for p in (tmp_path / "m").iterdir())
    text = (tmp_path / "m" / "a_b.json").read_text()
    one = json.loads(text)
    assert text.startswith('{\n  "procedure_name": "a/b"') and [s["name"] for s in one["states"]] == [f"p_step_{i}" for i in range(1, 13)]
    # sequential transitions first, in the order of the states
    assert [t["source_state"] for t in one["transitions"]] == [f"p_step_{i}" for i in range(1, 12)] + ["p_step_10", "p_step_2"]
    sinks.write_machines(fsm.to_dot(made, moves), "dot", folder, "dot")
    lines = (tmp_path / "m" / "a_b.dot").read_text().split("\n")
    assert [x.split('"')[1] for x in lines if "shape=" in x and "label" in x] == [f"p_step_{i}" for i in range(1, 13)] and lines[-1] == "}"
    assert '  "p_step_2" -> "p_step_3" [label="Service Request"];' in lines


def test_variants_and_vectors(spark):
    p = packets.as_variant(spark.createDataFrame([('{"a": [1, {"b": 2}]}',), ("no",)], "payload string"))
    assert [r[0] for r in p.select(F.expr("variant_get(payload, '$.a[1].b', 'int')")).collect()] == [2, None]
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [0.5, 0.5])], "k int, v array<float>")
    assert {r["k"]: r["vector"] for r in vx.as_vectors(vx.mean_pool(rows, "k", "v"), "k").collect()} == {1: [2.0, 3.0], 2: [0.5, 0.5]}


def test_texts(spark):
    t = spark.createDataFrame([("The procedure shall be initiated",), ("Tables",)], "t string")
    assert [r[0] for r in t.select(evidence.is_procedural(F.col("t"))).collect()][1] is False
    rows = spark.createDataFrame([(1, "UE and DN and AF with the registration procedure of SUPI")], "section int, text string")
    got = {r["name"]: r["entity_type"] for r in extract.recognised(rows).collect()}
    assert not {"UE", "DN", "AF"} & set(got) and got["SUPI"] == "Parameter" and got["registration procedure"] == "Procedure"
    hits = spark.createDataFrame([(1, 0, "SUPI", "Key", 1)], "section int, pos int, name string, entity_type string, method_ord int")
    assert {r["name"]: r["entity_type"] for r in extract.recognised(rows, hits=hits).collect()}["SUPI"] == "Key"
