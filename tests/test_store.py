import random

import pytest
from pyspark.sql import functions as F

from fathomweave.operators import store

SCHEMA = "name string, kind string, properties map<string,string>, note string, seq bigint"


def made(seed, n):
    r = random.Random(seed)
    return [(r.choice(["a", "b", "c", None, "é"]) if r.random() < 0.3 else f"n{r.randint(0, 40)}", r.choice(["x", "y"]), r.choice([None, {}, {"p": str(i)}, {"q": str(i), "p": None}]), f"t{i}", i) for i in range(n)]


def plain(rows, policy):
    out = {}
    for name, kind, props, note, seq in sorted(rows, key=lambda x: x[4], reverse=policy == "first"):
        before = out.get((name, kind), (None, {}, None))[1]
        out[name, kind] = (seq, {**before, **(props or {})} if policy == "entries" else props, note)
    return out


def stored(df):
    return {(r["name"], r["kind"]): (r["seq"], r["properties"], r["note"]) for r in df.collect()}


@pytest.mark.parametrize("policy", store.POLICIES)
def test_batches_in_any_order_equal_one(spark, tmp_path, policy):
    rows = made(1, 300)
    batches = [rows[200:], rows[:100], rows[100:200], rows[150:250]]  # out of order, and some of it twice
    path = str(tmp_path / "s")
    for b in batches:
        store.merge(spark.createDataFrame(b, SCHEMA), path, ["name", "kind"], policy=policy, buckets=8)
    got = store.read(spark, path)
    assert got.count() == len(plain(rows, policy)) and stored(got) == plain(rows, policy)
    store.merge(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "one"), ["name", "kind"], policy=policy, buckets=3)
    assert stored(store.read(spark, str(tmp_path / "one"))) == plain(rows, policy)
    # a version stays what it was
    assert stored(store.read(spark, path, 0)) == plain(batches[0], policy)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    store.merge(spark.createDataFrame(made(2, 200), SCHEMA), path, ["name", "kind"], buckets=16)
    before = store.manifest(spark, path).folders
    store.merge(spark.createDataFrame([("n1", "x", None, "new", 999)], SCHEMA), path, ["name", "kind"])
    after = store.manifest(spark, path).folders
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == len(before)
    assert store.read(spark, path, only=[("n1", "x")]).collect()[0]["note"] == "new"
    assert len(store.read(spark, path, only=[("n1", "x")]).inputFiles()) == 1
    assert store.read(spark, path, only=[("nobody", "x")]).count() == 0


@pytest.mark.parametrize("step", ["data", "draft", "rename"])
def test_a_crash_between_two_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    path, rows = str(tmp_path / "s"), made(3, 200)
    store.merge(spark.createDataFrame(rows[:100], SCHEMA), path, ["name", "kind"], buckets=4)
    real = store._put

    def crash(spark_, path_, m):
        if step == "draft":  # half a manifest under a name that doesn't count
            (tmp_path / "s" / "manifest" / "draft-1").write_text('{"keys": ["na')
        elif step == "rename":
            real(spark_, path_ + "x", m)
        raise OSError("lost")

    monkeypatch.setattr(store, "_put", crash)
    with pytest.raises(OSError, match="lost"):
        store.merge(spark.createDataFrame(rows[100:], SCHEMA), path, ["name", "kind"])
    monkeypatch.setattr(store, "_put", real)
    assert stored(store.read(spark, path)) == plain(rows[:100], "last")
    store.merge(spark.createDataFrame(rows[100:], SCHEMA), path, ["name", "kind"])
    assert stored(store.read(spark, path)) == plain(rows, "last")
    assert store.vacuum(spark, path, keep=1) >= 4
    assert stored(store.read(spark, path)) == plain(rows, "last") and store.versions(spark, path) == [1]


def test_empty_batches_and_repeats(spark, tmp_path):
    path, none = str(tmp_path / "s"), spark.createDataFrame([], SCHEMA)
    assert store.read(spark, path) is None
    assert store.merge(none, path, ["name", "kind"]) == 0 and store.read(spark, path).count() == 0
    rows = made(4, 50)
    store.merge(spark.createDataFrame(rows, SCHEMA), path, ["name", "kind"])
    first = stored(store.read(spark, path))
    assert store.merge(none, path, ["name", "kind"]) == 1
    store.merge(spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit(1)), path, ["name", "kind"])
    assert stored(store.read(spark, path)) == first == plain(rows, "last")
    with pytest.raises(RuntimeError, match="another"):
        store._put(spark, path, store.manifest(spark, path))


def test_rows_are_dealt_once(spark):
    """What is grouped by the keys stays where the rows of a bucket are; no join brings maps and the rest together."""
    rows = spark.range(100).selectExpr("id % 7 as _bucket", "id % 14 as key", "id as seq", "map('a', struct(id as v, id as seq)) as props", "map(1, struct('x' as v, id as seq)) as more")
    plan = store._merged(rows.repartition(5, "_bucket"), ["_bucket", "key"], "seq", "entries")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_key_with_many_rows(spark, tmp_path, monkeypatch):
    """The crowded bucket is merged in part before it moves; the table is the same."""
    rows = spark.range(900).selectExpr("if(id % 3 = 0, id % 40, -1) as key", "pmod(id * 7919, 900) as seq", "map(concat('p', id % 5), id, 'all', -id) as props", "if(id % 2 = 0, map(id % 4, 'v'), null) as more")
    for policy in store.POLICIES:
        got = []
        for least in (1, 1 << 16):
            monkeypatch.setattr(store, "LEAST_ROWS", least)
            path = f"{tmp_path}/{policy}-{least}"
            for k in (1, 0):
                store.merge(rows.where(f"seq % 2 = {k}"), path, ["key"], policy=policy)
            got.append(sorted(repr((r["key"], r["seq"], sorted(r["props"].items()), r["more"] and sorted(r["more"].items()))) for r in store.read(spark, path).collect()))
        assert got[0] == got[1] and len(got[0]) == 41
