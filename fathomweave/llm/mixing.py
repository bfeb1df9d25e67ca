"""Operator 6: mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how often each of its documents should be taken: a whole number of times
and a fraction. Two documents with fractions are paired and mass (fraction times size) is moved from one to
the other, in a direction drawn so that both keep their expectation, until one fraction is 0 or 1. That one
is settled; the other meets the next. The words of a source thus stay at its target all along, but for the
one document that is left at the end. Documents are spread over groups of about FAN_IN by a hash, each group
passes on the one it has left, and these meet in groups again: a reduction tree, whose depth is the logarithm
of the largest source. In a group the long documents meet first, so that what is left over at the end is short. Rows that are alike in doc_id, source and size are settled among themselves first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.runtime import write_table

FAN_IN = 256
MOST, SALTS = 3, 64
WEIGHTS = (1, 2, 3)
ITEM = "struct<large:bigint,h:bigint,doc_id:bigint,size:bigint,mark:bigint,p:double>"
DONE = "struct<doc_id:bigint,size:bigint,mark:bigint,pick:double>"


def word_count(text: str = "text") -> Column:
    return F.expr(rf"cast(regexp_count(coalesce(cast({text} as string), ''), '[^\\x20\\x09-\\x0D]+') as bigint)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size, target from one row (source, n, source_size) for each source.

    Sources by code point, null last, weigh ``weights`` in turn; shares add up to all words. A target stops at
    ``most`` times its source, and what is over is shared by weight among the others until none is above: in
    order of size over weight, all sources before some place are at their bound, and those from it on share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("w", w).withColumn("bound", F.col("source_size") * float(most)).withColumn("at", F.col("bound") / F.col("w"))
    ranked = Window.orderBy("at", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("full", F.coalesce(F.sum("bound").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("w").over(ranked.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(every).cast("double"))
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(every)
    return rows.withColumn("level", F.coalesce(level, F.lit(0.0))).select("source", "n", "source_size", F.least(F.col("w") * F.col("level"), "bound").alias("target"))


def _met(items: str, seed: int) -> str:
    """SQL: what is left (r) and what is settled (out) when the items of an array meet one after another."""
    u = f"(shiftrightunsigned(xxhash64({seed}L, a.h, x.h, a.doc_id, x.doc_id), 11) / 9007199254740992.0D)"
    step = f"""get(transform(array(acc.r), a ->
      get(transform(array(struct(least(a.p * a.size, (1 - x.p) * x.size) as give, least((1 - a.p) * a.size, x.p * x.size) as get)), d ->
      get(transform(array({u} * (d.give + d.get) < d.get), gives ->
      get(transform(array(struct(
        if(gives, if(d.give = a.p * a.size, 0D, a.p - d.give / a.size), if(d.get = (1 - a.p) * a.size, 1D, a.p + d.get / a.size)) as a,
        if(gives, if(d.give = (1 - x.p) * x.size, 1D, x.p + d.give / x.size), if(d.get = x.p * x.size, 0D, x.p - d.get / x.size)) as x)), p ->
      if(p.a = 0D or p.a = 1D,
        struct(struct(x.large as large, x.h as h, x.doc_id as doc_id, x.size as size, x.mark as mark, p.x as p) as r, concat(acc.out, array(struct(a.doc_id as doc_id, a.size as size, a.mark as mark, p.a as pick))) as out),
        struct(struct(a.large as large, a.h as h, a.doc_id as doc_id, a.size as size, a.mark as mark, p.a as p) as r, concat(acc.out, array(struct(x.doc_id as doc_id, x.size as size, x.mark as mark, p.x as pick))) as out))), 0)), 0)), 0)), 0)"""
    start = f"cast(struct(null as r, array() as out) as struct<r:{ITEM},out:array<{DONE}>>)"
    return f"aggregate({items}, {start}, (acc, x) -> if(acc.r is null, struct(x as r, acc.out as out), {step}))"


def decide(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, mark (a hash of the text): a row for each row of ``docs`` (doc_id, source, text).

    copies (0 to ``most``) says how often the row is taken. Null texts have size 0; a document without words
    takes nothing whatever its copies; null is a source, the last; repeated rows get a row each; extra
    columns are ignored; an empty table gives no rows. Reruns agree, however the input is split.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    alike, _ = write_table(rows.groupBy("source", "doc_id", "size", "mark").agg(F.count("*").alias("m")), "sizes")
    goal, _ = write_table(targets(alike.groupBy("source").agg(F.sum("m").alias("n"), F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, most), "targets")
    biggest = goal.agg(F.max("n")).first()[0] or 0
    q = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    facts = ["source", "source_size", "target", "base"]
    items = alike.withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).join(goal.withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))), "source")
    items = items.withColumn("q", F.least(q, F.lit(float(most)))).withColumn("base", F.floor("q").cast("bigint")).withColumn("p", F.col("q") - F.col("base"))
    h = F.xxhash64(F.lit(seed), "doc_id", "size", "mark")
    # of m rows that are alike, this many take one more, and at most one is left with a fraction
    items = items.withColumn("whole", F.floor(F.col("m") * F.col("p")).cast("bigint")).withColumn("part", F.col("m") * F.col("p") - F.col("whole")).withColumn("h", h)
    plain = (F.col("size") == 0) | (F.col("part") <= 0)
    settled = items.select(*facts, "doc_id", "size", "mark", F.expr("inline(array(struct(whole as k, 1D as pick), struct(m - whole - if(size = 0 or part <= 0, 0, 1) as k, 0D as pick)))")).where("k > 0").select(*facts, "doc_id", "size", "mark", "pick", "k")
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN)).cast("bigint")
    level = items.where(~plain).select(*facts, F.pmod("h", groups).alias("at"), F.struct((-F.col("size")).alias("large"), "h", "doc_id", "size", "mark", F.col("part").alias("p")).alias("item"))
    left = -(-biggest // FAN_IN)
    while True:
        met = level.groupBy(*facts, "at").agg(F.array_sort(F.collect_list("item")).alias("items")).select(*facts, "at", F.expr(_met("items", seed)).alias("end"))
        met, _ = write_table(met, "met")
        settled = settled.union(met.select(*facts, F.expr("inline(end.out)")).select(*facts, "doc_id", "size", "mark", "pick", F.lit(1).cast("bigint").alias("k")))
        if left <= 1:
            break
        left = -(-left // FAN_IN)
        level = met.select(*facts, F.floor(F.col("at") / FAN_IN).cast("bigint").alias("at"), F.col("end.r").alias("item"))
    last = met.select(*facts, "end.r.doc_id", "end.r.size", "end.r.mark", F.when(F.col("end.r.p") >= 0.5, 1.0).otherwise(0.0).alias("pick"), F.lit(1).cast("bigint").alias("k"))
    each = settled.union(last).withColumn("one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k"))))
    return each.select("doc_id", F.expr("if(source = 'null', cast(null as string), substring(source, 2))").alias("source"), "size", "source_size", "target", (F.col("base") + F.col("pick").cast("bigint")).alias("copies"), "mark")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as they are taken, with the columns of ``docs``.

    Rows alike in doc_id, source and text share their copies evenly; of what doesn't divide each of the first
    takes one more. They are numbered within each of SALTS parts of such a group, and the parts are added up, so that no task
    gets a large group. Null doc_id, source and text are values like others; an empty table stays empty.
    """
    names = ["doc", "origin", "length", "mark"]
    taken = decide(docs, seed).groupBy("doc_id", "source", "size", "mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("m")).where("copies > 0")
    taken = taken.select(*[F.col(a).alias(b) for a, b in zip(("doc_id", "source", "size", "mark"), names, strict=True)], F.expr("copies div m").alias("each"), F.expr("copies % m").alias("more"))
    taken, _ = write_table(taken, "taken")
    # the input's columns travel in one struct, so that no name can clash
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("bigint").alias("doc"), docs["source"].cast("string").alias("origin"), docs["text"].cast("string").alias("text"))
    own = own.select("row", "doc", "origin", word_count().alias("length"), F.xxhash64("text").alias("mark"))

    def met(some: DataFrame) -> DataFrame:
        return own.join(some, [own[c].eqNullSafe(some[c]) for c in names]).select("row", *[some[c] for c in names], "each", "more")

    times = lambda n: F.explode(F.sequence(F.lit(1).cast("bigint"), n))
    even = met(taken.where("more = 0")).select("row", times(F.col("each"))).select("row.*")
    uneven = taken.where("more > 0")
    if uneven.isEmpty():
        return even
    odd, _ = write_table(met(uneven).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "repeated")
    parts = odd.groupBy(*names, "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in [*names, "salt"]], before.alias("before"))
    numbered = odd.withColumn("at", F.row_number().over(Window.partitionBy(*names, "salt").orderBy("mark")))
    numbered = numbered.join(parts, [numbered[c].eqNullSafe(parts[f"_{c}"]) for c in [*names, "salt"]])
    count = F.col("each") + F.when(F.col("at") + F.col("before") <= F.col("more"), 1).otherwise(0)
    return even.union(numbered.withColumn("count", count).where("count > 0").select("row", times(F.col("count"))).select("row.*"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
