"""Noun phrases found in the texts themselves: pairs of neighbouring words that stand together more often than chance.

Counts are sums of the whole corpus, made in part before each shuffle. A pair is a collocation if its pointwise mutual information is high
and it is met beside several different words on the left and on the right, so that parts of longer fixed strings don't
count. The phrases of a text are its runs of collocations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomweave.runtime import write_table

#: What ends a run of words.
MARK = r"[^\p{L}\p{N}\s_'-]+"
LEAST_COUNT, LEAST_PMI, LEAST_SIDES, LONGEST = 5, 3.0, 3, 3
EDGE = ""


def words(text: Column) -> Column:
    """Array of lower-case words, with an empty one for each mark between them and at both ends."""
    marked = F.regexp_replace(F.lower(text), MARK, " \u0000 ")
    kept = F.filter(F.split(marked, r"\s+"), lambda w: w != "")
    return F.concat(F.array(F.lit(EDGE)), F.transform(kept, lambda w: F.when(w == "\u0000", F.lit(EDGE)).otherwise(w)), F.array(F.lit(EDGE)))


def neighbours(texts: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """(keys, at, before, a, b, after): every two words that follow one another, with the words around them; null texts have none."""
    ws = texts.where(F.col(text).isNotNull()).select(*(keys or []), words(F.col(text)).alias("ws"))
    one = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("ws") - 2)), lambda i: F.struct(i.alias("at"), F.get("ws", i - 2).alias("before"), F.get("ws", i - 1).alias("a"), F.get("ws", i).alias("b"), F.get("ws", i + 1).alias("after")))
    return ws.where(F.size("ws") > 3).select(*(keys or []), F.inline(F.filter(one, lambda x: (x["a"] != EDGE) & (x["b"] != EDGE))))


def collocations(texts: DataFrame, text: str = "text", least_count: int = LEAST_COUNT, least_pmi: float = LEAST_PMI, least_sides: int = LEAST_SIDES) -> DataFrame:
    """(a, b, n, lefts, rights, pmi) of the pairs that pass all three tests; pmi: log2 of n times the number of words over the product of the words' own counts.

    lefts, rights: beside how many different words or ends a pair stands on either side.
    """
    # texts are cut into words once, and read as words three times
    ws, _ = write_table(texts.where(F.col(text).isNotNull()).select(words(F.col(text)).alias("ws")), "texts")
    spoken = ws.select(F.explode("ws").alias("w")).where(F.col("w") != EDGE).groupBy("w").agg(F.count("*").alias("m"))
    spoken, _ = write_table(spoken, "words")
    total = spoken.agg(F.sum("m")).first()[0] or 0
    later = lambda k: F.slice("ws", k + 1, F.size("ws"))
    both = lambda x: (x["a"] != EDGE) & (x["b"] != EDGE)
    met = ws.select(F.inline(F.filter(F.arrays_zip(F.col("ws").alias("a"), later(1).alias("b")), both))).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    left, right = spoken.select(F.col("w").alias("a"), F.col("m").alias("an")), spoken.select(F.col("w").alias("b"), F.col("m").alias("bn"))
    pmi = F.log2(F.col("n") * F.lit(float(total)) / F.col("an") / F.col("bn"))
    high, _ = write_table(met.join(left, "a").join(right, "b").withColumn("pmi", pmi).where(F.col("pmi") >= least_pmi).select("a", "b", "n", "pmi"), "pairs")
    # what stands beside a pair is looked at for these alone
    four = F.arrays_zip(F.col("ws").alias("before"), later(1).alias("a"), later(2).alias("b"), later(3).alias("after"))
    rows = ws.select(F.inline(F.filter(four, both))).join(high.select("a", "b"), ["a", "b"], "left_semi")
    sides = rows.select("a", "b", F.expr("inline(array(struct(0 as side, before as w), struct(1 as side, after as w)))")).groupBy("a", "b", "side", "w").agg(F.lit(1).alias("one"))
    sides = sides.groupBy("a", "b").agg(F.count_if(F.col("side") == 0).alias("lefts"), F.count_if(F.col("side") == 1).alias("rights")).where((F.col("lefts") >= least_sides) & (F.col("rights") >= least_sides))
    return high.join(sides, ["a", "b"]).select("a", "b", "n", "lefts", "rights", "pmi")


def phrases(texts: DataFrame, key: str, pairs: DataFrame, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(key, at, phrase): the runs of collocations in each text, up to ``longest`` words; of a longer run its parts of that length, one after another.

    ``key`` tells rows apart.
    """
    met = neighbours(texts, text, [key]).join(pairs.select("a", "b"), ["a", "b"])
    order = Window.partitionBy(key).orderBy("at")
    runs = met.withColumn("new", F.coalesce(F.col("at") != F.lag("at").over(order) + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    inside = Window.partitionBy(key, "run").orderBy("at")
    placed = runs.withColumn("i", F.row_number().over(inside) - 1)
    # word i of a run goes to part i / longest; the last pair gives two words
    both = placed.withColumn("last", F.lead("at").over(inside).isNull()).select(key, "run", F.expr("inline(if(last, array(struct(i, at, a as w), struct(i + 1 as i, at + 1 as at, b as w)), array(struct(i, at, a as w))))"))
    parts = both.groupBy(key, "run", F.floor(F.col("i") / longest).alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("ws"), F.min("at").alias("at"))
    return parts.where(F.size("ws") > 1).select(key, F.col("at").cast("int").alias("at"), F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("phrase"))
