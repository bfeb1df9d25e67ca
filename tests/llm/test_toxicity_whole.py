"""Operator 7 learns from every labelled row, its language trees from every row with a language."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fathomweave import runtime
from fathomweave.llm import langid, neardup, toxicity
from tests.llm.common import words


def learns(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 > 0


def test_all_labelled_rows_count(spark, monkeypatch):
    """Rows beyond the sample, and texts longer than it takes, are in the thresholds and in the network, however the table is cut."""
    r = random.Random(1)
    rows = [(i, " ".join([*(f"w{r.randrange(300)}" for _ in range(r.randint(5, 40))), *(["loserix"] if i % 4 == 0 else []), "end"])) for i in range(700)]
    rows[8] = (8, words(6000, 1) + " loserix")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id bigint, toxic int")
    seen, real = [], toxicity.calibrated

    def calibrated(values, truth, n):
        seen.append(n[truth == 1].sum())
        seen.append(n[truth == 0].sum())
        return real(values, truth, n)

    monkeypatch.setattr(toxicity, "calibrated", calibrated)
    monkeypatch.setattr(toxicity, "SHARD", 64)
    net = toxicity.fit(docs, labels, per_class=30)
    own = [i for i, _ in rows if learns(i)]
    assert seen[:2] == [sum(i % 4 == 0 for i in own), sum(i % 4 > 0 for i in own)]
    again = toxicity.fit(docs.repartition(5), labels.repartition(3), per_class=30)
    assert np.allclose(net.rows(), again.rows(), atol=1e-6) and net.thresholds == again.thresholds
    rest = [(x["doc_id"], x["predicted"]) for x in toxicity.score(docs, net).where("held_out").collect()]
    assert sum(y == (i % 4 == 0) for i, y in rest) >= 0.95 * len(rest)
    # no text that the sample could take has the label 1: all is learned in the shards
    short = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" " + "w7 " * 40))).otherwise(F.col("text")))
    assert toxicity.fit(short, labels, longest=100) is not None


def test_rows_of_a_network():
    net = toxicity.train(["a b c", "d e f"], [0, 1], [1.0, 1.0], epochs=2)
    back = net.from_rows(net.rows())
    assert all(np.array_equal(x, y) for x, y in zip(net.parts().values(), back.parts().values(), strict=True))
    assert net.rows().shape[1] == toxicity.DIM and list(net.parts()) == list(back.parts())


def test_pairs_of_all_texts(spark, monkeypatch):
    """Trees counted by Spark are those of training on all texts, and blocks don't change what is told."""
    rows = [(i, words(30 + i, i) if i % 2 else f"été {i} où la forêt naïve", "en" if i % 2 else "fr") for i in range(120)] + [(200, None, "en"), (201, "", "en"), (202, "x", None), (None, "y", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts = {x: [t.encode() for i, t, y in rows if y == x and t and i is not None and learns(i)] for x in ("en", "fr")}
    want = langid.train(texts, 1)
    got = langid.fit_pairs(docs.repartition(3))
    assert got.languages == want.languages == ["en", "fr"]
    for a, b in zip(got.trees, want.trees, strict=True):
        for name in ("windows", "bits", "contexts", "escapes"):
            assert all(np.array_equal(x, y) for x, y in zip(getattr(a, name), getattr(b, name), strict=True))
    some = [t.encode() for _, t, _ in rows if t]
    assert np.allclose(got.code_lengths(some)[3], sum(np.array([t.cost(np.array([x << 8 | y], np.uint32))[0] for t in want.trees]) for x, y in zip(b" " + some[3], some[3], strict=False)))
    one = [got.predict(t) for t in some]
    monkeypatch.setattr(langid, "BLOCK", 500)
    assert [x for x, _ in got.predict_all(some)] == [x for x, _ in one] and len(got.predict_all(some)) == len(some) and got.predict_all([]) == []
    assert langid.fit_pairs(docs.where("lang is null")) is None


def test_worker_keeps_one_thing():
    a, b = runtime.held(("t", 1), list), runtime.held(("t", 1), list)
    assert a is b and runtime.held(("t", 2), dict) == {} and runtime.held(("t", 1), list) is not a and len(runtime._HELD) == 1


def test_stages_that_keep_nothing_let_go():
    for stage in (neardup._can(0.8), neardup._alike(0.8)):
        runtime.held(("t", 1), list)
        assert list(stage(iter([]))) == [] and not runtime._HELD


def test_features_of_many_words():
    some = ["a", "ab", "abc", "naïve", "日本", "x" * 64, "_", "word_1", *(words(300, 5).split()), "\ud800x"]
    flat, begin, size = toxicity.all_features(some)
    assert [flat[b : b + n].tolist() for b, n in zip(begin, size, strict=True)] == [toxicity.features(w) for w in some] and sum(size) == len(flat)
    assert all(len(x) == 0 for x in toxicity.all_features([]))
