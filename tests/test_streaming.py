from pyspark.sql import functions as F

from fathomweave.streaming import events as ev
from tests.oracle import SF


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    late = table.orderBy(F.desc("ts")).limit(1).select((F.lit(-1)).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("interval 3 days")).alias("ts"), "user_id", "event_type", "value", "props")
    table.coalesce(1).write.parquet(src)
    stream = ev.counts(spark.readStream.schema(table.schema).parquet(src))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    key = lambda df: {(r["window_start"], r["event_type"]): r["n"] for r in df.collect()}
    assert key(spark.read.parquet(out)) == key(ev.counts(table))


def test_upsert(spark, tmp_path):
    f = ev.upsert(str(tmp_path / "t"), ["k"], "seq", 4)
    f(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string"), 0)
    for _ in range(2):
        f(spark.createDataFrame([(1, 2, "c"), (3, 1, "d"), (2, 0, "old")], "k int, seq int, v string"), 1)
    # what a crash leaves behind is in no manifest and doesn't count
    spark.createDataFrame([(9, 9, "z")], "k int, seq int, v string").write.parquet(str(tmp_path / "t" / "data" / "lost" / "bucket=1"))
    assert ev.current(spark, str(tmp_path / "none")) is None
    assert sorted(map(tuple, ev.current(spark, str(tmp_path / "t")).collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    f(spark.createDataFrame([(9, 1, "y")], "k int, seq int, v string"), 2)
    assert ev.current(spark, str(tmp_path / "t")).where("k = 9").first()["v"] == "y"
    assert not (tmp_path / "t" / "data" / "lost").exists()


def test_stream_into_buckets(spark, tmp_path):
    """Micro-batches of the events end in the table that one batch gives."""
    table = spark.read.parquet(f"{SF}/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "t")
    table.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(ev.upsert(out, ["user_id", "event_type"], "event_id", 8)).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = table.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    key = lambda df: sorted((r["user_id"], r["event_type"], r["event_id"]) for r in df.collect())
    assert key(ev.current(spark, out)) == key(want)
