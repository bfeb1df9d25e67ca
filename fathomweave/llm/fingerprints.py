"""Operator 9: document fingerprints by SimHash, with permuted block tables for the search.

Terms are pairs of neighbouring words; a term votes with its weight (longer words, more weight) on each of
128 bits, once for each time it occurs. Counters of two bits share one number (32 bits each, more than the
longest text can fill), so a text's votes are 64 plain sums over its terms, made where the text lies: terms
never cross the network. Likeness of two fingerprints is the cosine that their differing bits estimate.

For the search the bits are cut into radius + d blocks: fingerprints at most ``radius`` bits apart agree on at least d
whole blocks, so they meet in the table of the two lowest of these, and again with a third, up to a d-th. d grows with
the number of fingerprints, so that unlike ones seldom share a whole key. Within the buckets each is compared with the first
and with the one before it, which is linear, and in buckets of up to SMALL rows with all. Only the rows of larger buckets
get keys of one more block. What is still large then are crowds of alike ones: where these hold several groups that no
link has joined, all of different groups are compared.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.llm.components import connected_components
from fathomweave.runtime import drop_table, write_table

BITS = 128
LANE = (1 << 32) | 1
#: Rows in a range of doc_id, and into how many parts a level of ranges is cut at most.
PER_BUCKET, MOST_PARTS = 4000, 4096
#: A replaced word moves about 7 bits of 128 in a text of 100 words, 5 in one of 200; unlike texts differ in about 64.
RADIUS = 11
#: Buckets of up to SMALL rows are compared in full; one row in SAMPLE tells of hot keys, which have HOT such rows or more.
SMALL, SAMPLE, HOT = 16, 64, 8


def terms(text: str) -> str:
    """SQL: array of (h, w), the hash and weight of each pair of neighbouring words; of a single word, if there's just one."""
    words = rf"filter(split(lower({text}), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    pair = "struct(xxhash64(get(ws, i), get(ws, i + 1)) as h, 1 + if(length(get(ws, i)) > 3, 1, 0) + if(length(get(ws, i + 1)) > 3, 1, 0) as w)"
    some = f"transform(sequence(0, size(ws) - 2), i -> {pair})"
    return f"get(transform(array({words}), ws -> if(size(ws) > 1, {some}, transform(ws, x -> struct(xxhash64(x) as h, 1 as w)))), 0)"


def _votes() -> list[Column]:
    """A sum for each two bits, and that of all weights, over rows (h, h2, w)."""
    lanes = [(F.shiftrightunsigned(x, s).bitwiseAND(F.lit(LANE)) * F.col("w")) for x in (F.col("h"), F.col("h2")) for s in range(32)]
    return [F.sum(x).alias(f"v{i}") for i, x in enumerate(lanes)] + [F.sum(F.col("w").cast("bigint")).alias("all")]


def _halves() -> list[Column]:
    """The two 64-bit halves: a bit is set if over half of all weight voted for it."""
    out = []
    for half in range(2):
        value = F.lit(0).cast("bigint")
        for s in range(32):
            v = F.col(f"v{32 * half + s}")
            low, high = v.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(v, 32)
            for count, at in ((low, s), (high, s + 32)):
                bit = (1 << at) - (1 << 64) if at == 63 else 1 << at
                value = value.bitwiseOR(F.when(count * 2 > F.col("all"), F.lit(bit)).otherwise(F.lit(0)).cast("bigint"))
        out.append(value.alias(f"f{half}"))
    return out


def fingerprint(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, f0, f1: the fingerprint of each row's text; no word: zero. ``keys`` tell the rows apart."""
    voted = rows.select(*keys, F.expr(f"inline_outer({terms(text)})")).withColumn("h2", F.xxhash64(F.lit(1), "h")).groupBy(*keys).agg(*_votes())
    return voted.select(*keys, *_halves())


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    differing = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.cos(differing * F.lit(3.141592653589793 / BITS))))


def text_of(f0: str, f1: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (f1, f0)])


def _reached(values: str, most: int) -> Column:
    """SQL: how many of ``values`` (sorted, at most ``most``) are at most doc_id, by halving; 0 for null."""
    steps = [1 << k for k in reversed(range(most.bit_length()))] or [0]
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, s) -> if(coalesce(get({values}, at + s - 1) <= doc_id, false), at + s, at))")


def _cuts(parts: int) -> Column:
    """Values of doc_id that cut rows into about ``parts`` equal ones; each but the first part starts with its value."""
    found = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts) if parts > 1 else F.max(F.array().cast("array<bigint>"))
    return F.struct(F.min("doc_id").alias("lo"), F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<bigint>")))).alias("all"))


def beside_next(docs: DataFrame) -> DataFrame:
    """b, at, ghost, doc_id, text, next_text: each row with the text of the next by doc_id, the last with the first.

    Rows are dealt into ranges of doc_id, each with a second copy of the first row of the next range ("ghost"),
    so one shuffle of the texts does. The ranges are cut in two levels, so that up to 67 billion rows they stay
    at some ``PER_BUCKET`` rows. Null doc_id comes first; rows of one doc_id stand in the order of a hash of their text.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, -(-n // PER_BUCKET))
    parts = min(MOST_PARTS, ranges)
    within = min(MOST_PARTS, -(-ranges // parts))
    first, cuts = rows.agg(_cuts(parts).alias("x")).select("x.lo", "x.all").first()
    bounds = [b for b in cuts or [] if b > first]  # at most MOST_PARTS
    literal = f"array({', '.join(f'{b}L' for b in bounds)})" if bounds else "cast(array() as array<bigint>)"
    dealt = rows.withColumn("part", _reached(literal, len(bounds)))
    if within > 1:
        # at most MOST_PARTS rows, each of at most as many numbers
        finer = dealt.select("part", "doc_id").groupBy("part").agg(_cuts(within).alias("x")).select("part", F.expr("filter(x.all, c -> c > x.lo)").alias("cuts"))
        whole = Window.partitionBy(F.lit(0))
        finer = finer.withColumn("prior", F.coalesce(F.lag(F.size("cuts")).over(whole.orderBy("part")), F.max_by(F.size("cuts"), "part").over(whole)))
        dealt = dealt.join(F.broadcast(finer), "part")
    else:
        dealt = dealt.withColumns({"cuts": F.array().cast("array<bigint>"), "prior": F.lit(0)})
    dealt = dealt.withColumn("sub", _reached("cuts", within - 1))
    least = F.lit(None if nulls else first).cast("bigint")
    start = F.when(F.col("sub") > 0, F.expr("get(cuts, sub - 1)")).when(F.col("part") > 0, F.expr(f"get({literal}, part - 1)")).otherwise(least)
    known = dealt.select(
        "doc_id", "text", (F.col("part") * within + F.col("sub")).alias("b"), F.col("doc_id").eqNullSafe(start).alias("is_first"),
        F.when(F.col("sub") > 0, F.col("part") * within + F.col("sub") - 1).otherwise(F.pmod(F.col("part") - 1, F.lit(len(bounds) + 1)) * within + F.col("prior")).alias("before"),
    )
    places = F.expr("inline(if(is_first, array(struct(b as b, false as ghost), struct(before as b, true as ghost)), array(struct(b as b, false as ghost))))")
    both = known.select("doc_id", "text", places)
    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return both.select("b", F.row_number().over(order).alias("at"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def _blocks(n: int) -> list[tuple[int, int]]:
    """Masks (for f0 and f1, signed) of ``n`` blocks of nearly the same width."""
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    wide = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    sign = lambda m: m - (1 << 64) if m >> 63 else m
    return [(sign(m & ((1 << 64) - 1)), sign(m >> 64)) for m in wide]


def _depth(n: int, radius: int) -> int:
    """How many blocks a key needs so that ``n`` unlike fingerprints leave about one to a bucket."""
    return next((d for d in range(2, BITS - radius) if d * BITS // (radius + d) >= max(1, n).bit_length()), 2)


def _first_keys(radius: int, blocks: list[tuple[int, int]]) -> Column:
    """(key, upto) for the two lowest blocks that near fingerprints can agree on: what they show, with their numbers, as one hash."""
    show = lambda x, y: (F.col("f0").bitwiseAND(F.lit(blocks[x][0] | blocks[y][0]).cast("bigint")), F.col("f1").bitwiseAND(F.lit(blocks[x][1] | blocks[y][1]).cast("bigint")))
    return F.array(*[F.struct(F.xxhash64(F.lit(t), *show(x, y)).alias("key"), F.lit(y).alias("upto")) for t, (x, y) in enumerate(combinations(range(radius + 2), 2))])


def _further_keys(level: int, radius: int, blocks: list[tuple[int, int]]) -> Column:
    """(key, upto) with one more block, of a higher number: the ``level``-th that near fingerprints agree on is among the first radius + level."""
    masks = [f"array({', '.join(f'{m[half]}L' for m in blocks)})" for half in range(2)]
    return F.expr(f"transform(filter(sequence(upto + 1, {radius + level}), k -> k < {radius + level}), k -> struct(xxhash64(key, k, f0 & get({masks[0]}, k), f1 & get({masks[1]}, k)) as key, k as upto))")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))) + F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1")))


def _bucketed(rows: DataFrame, radius: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of all near pairs in buckets of up to SMALL rows and of some in larger ones; the rows of these (key, upto, f0, f1, node).

    Keys that hold many rows of a sample are hot and meet no window: their rows are compared with the bucket's least
    fingerprint alone, by an aggregate and a join, which may be split. A hot key that the sample misses is one large window.
    """
    seen = rows.where(F.xxhash64("f1", "f0").bitwiseAND(F.lit(SAMPLE - 1)) == 0).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("key")
    hot, path = write_table(seen, "hot-keys")
    paths.append(path)
    bucket = Window.partitionBy("key")
    order = bucket.orderBy("f0", "f1")
    beside = {"hub0": F.first("f0").over(order), "hub1": F.first("f1").over(order), "last0": F.lag("f0").over(order), "last1": F.lag("f1").over(order), "size": F.count("*").over(bucket)}
    beside = rows.join(hot, "key", "left_anti").withColumns(beside).where("size > 1")
    node = F.xxhash64("f0", "f1").alias("node")
    near = [F.when(_apart("f", x) <= radius, F.xxhash64(f"{x}0", f"{x}1")).alias(x) for x in ("hub", "last")]
    found = beside.select("key", "upto", "f0", "f1", "size", node, *near).where(f"size > 3 or hub is not null or last is not null")
    if hot.isEmpty():
        met = found
    else:
        crowd = rows.join(hot, "key")
        hubs = crowd.groupBy("key").agg(F.min(F.struct("f0", "f1")).alias("hub")).select("key", F.col("hub.f0").alias("hub0"), F.col("hub.f1").alias("hub1"))
        met = found.unionByName(crowd.join(hubs, "key").select("key", "upto", "f0", "f1", F.lit(1 << 40).alias("size"), node, near[0], F.lit(None).cast("bigint").alias("last")))
    met, path = write_table(met, "met")
    paths.append(path)
    beside = met.select(F.col("node").alias("u"), F.explode(F.array_compact(F.array("hub", "last"))).alias("v"))
    # the first and the one before settle buckets of up to three
    few = met.where(f"size between 4 and {SMALL}").groupBy("key").agg(F.collect_list(F.struct("node", "f0", "f1")).alias("of"))
    pairs = f"flatten(transform(of, (x, i) -> transform(filter(slice(of, i + 2, {SMALL}), y -> bit_count(x.f0 ^ y.f0) + bit_count(x.f1 ^ y.f1) <= {radius}), y -> struct(x.node as u, y.node as v))))"
    return beside.union(few.select(F.expr(f"inline({pairs})"))), met.where(f"size > {SMALL}").select("key", "upto", "f0", "f1", "node")


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """f0, f1, near_class for the distinct fingerprints of ``prints`` (f0, f1, doc_id).

    near_class is the smallest doc_id among all rows that can be reached over links of at most ``radius`` bits.
    """
    if not 0 <= radius <= BITS - 2:
        raise ValueError(f"radius must be 0 to {BITS - 2}")
    spark, paths = prints.sparkSession, []
    values, path = write_table(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("f0", "f1")), "values")
    paths.append(path)
    depth = _depth(values.count(), radius)
    blocks = _blocks(radius + depth)
    links, large = _bucketed(values.select("f0", "f1", F.inline(_first_keys(radius, blocks))), radius, paths)
    for level in range(3, depth + 1):
        more, large = _bucketed(large.select("f0", "f1", F.inline(_further_keys(level, radius, blocks))), radius, paths)
        links = links.union(more)
    parts, path = write_table(values.select("node").join(connected_components(links.where("u <> v").distinct(), paths), "node", "left").withColumn("component", F.coalesce("component", "node")), "parts")
    paths.append(path)
    # what is large to the last: buckets of a single group are done, in the others all of different groups are compared
    placed = large.join(parts, "node")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left, path = write_table(placed.join(mixed, "key"), "mixed")
    paths.append(path)
    a = left.select("key", "component", "f0", "f1")
    b = left.select("key", F.col("component").alias("v"), F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    more = a.join(b, "key").where((F.col("component") < F.col("v")) & (_apart("f", "g") <= radius)).select(F.col("component").alias("u"), "v").distinct()
    groups = connected_components(more, paths).withColumnRenamed("component", "whole").withColumnRenamed("node", "component")
    joined = values.join(parts.select("node", "component"), "node").join(groups, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    least = joined.groupBy("component").agg(F.min("first").alias("near_class"))
    classes, _ = write_table(joined.join(least, "component").select("f0", "f1", "near_class"), "near-classes")
    for done in paths:
        drop_table(spark, done)
    return classes


def compare_with_next(docs: DataFrame) -> DataFrame:
    """The digest of every row of ``docs`` (doc_id, text): see ``op9_fingerprints``.

    Null texts count as empty; texts without a word have fingerprint zero (and likeness 1 to one another);
    repeated rows are returned as often as they occur; other columns are ignored; a single row is its own
    next; an empty table gives no rows.
    """
    rows = beside_next(docs)
    n = F.length("text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.when(~F.col("ghost"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))))
    rows = rows.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    each = F.expr("inline(if(ghost, array(struct(0 as which, text as t)), array(struct(0 as which, text as t), struct(1 as which, edited as t))))")
    # rows stay in their ranges from here on: grouping by (b, at) needs no further shuffle
    keys = ["b", "at", "ghost", "which", "doc_id", "n_chars", "sha"]
    prints = fingerprint(rows.select("b", "at", "ghost", "doc_id", "n_chars", "sha", each), keys, "t")
    pick = lambda which, f: F.max(F.when(F.col("which") == which, F.col(f)))
    one = prints.groupBy("b", "at", "ghost", "doc_id", "n_chars", "sha").agg(pick(0, "f0").alias("f0"), pick(0, "f1").alias("f1"), pick(1, "f0").alias("e0"), pick(1, "f1").alias("e1"))
    order = Window.partitionBy("b").orderBy("at")
    one = one.withColumn("n0", F.lead("f0").over(order)).withColumn("n1", F.lead("f1").over(order)).where(~F.col("ghost"))
    table, _ = write_table(one.select("doc_id", "n_chars", "sha", "f0", "f1", "e0", "e1", "n0", "n1"), "fingerprints")
    return table


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return table.join(near_classes(table), ["f0", "f1"]).select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), text_of("f0", "f1").alias("fingerprint"), text_of("e0", "e1").alias("edited_fingerprint"),
        likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("n0", "n1")).alias("near_next"), "near_class",
    )
