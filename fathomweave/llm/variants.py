"""Operator 12: spelling variants by letter-parity masks in bands.

A word's mask has a bit for each class of letters, set if it occurs an odd number of times. One inserted or deleted letter
flips one bit, a replaced one at most two, so of three bands of the mask at least one stays as it is. Words whose
lengths differ by at most one are joined on equal bands and verified. Bands alone have a bounded number of values, so
their buckets would grow with the square of the vocabulary; each is therefore divided by half of the word: one edit lies
in the first half or in the second, and the other half stays. Both are properties of every near pair, so none is lost. A
pair that meets in several buckets is taken in the first of them alone, so no distinct is needed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.llm import sqltext
from fathomweave.runtime import drop_table, ship, write_table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_TIMES, RATIO, ONE_IN = 6, 5, 5, 199
BANDS, BAND_BITS = 3, 21
#: Words that a task counts before it passes them on.
HELD = 1 << 18


def _counted(least: int, one_in: int | None):
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = text.as_py()
                if not whole:
                    continue
                # bytes.lower changes A-Z alone
                found = Counter(runs.findall(whole.encode().lower().decode()))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    if one_in:
                        h = zlib.crc32(word.encode(), start)
                        if h % one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, one_in: int | None = ONE_IN) -> DataFrame:
    """word, n: the runs of letters of all whole texts (doc_id, text), A-Z in lower case, that are long and frequent enough.

    Where ``one_in`` divides crc32 of ``doc_id:run`` (null doc_id: empty), the run loses the code point at that number modulo its
    length; None leaves all as they are. Null texts have no runs; repeated rows count again; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_counted(least_length, one_in), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def mask(word: str) -> Column:
    """63 bits of the parity of letters, BANDS bands of BAND_BITS; neighbours in the alphabet go to different bands."""
    bit = f"(ascii(c) % {BANDS}) * {BAND_BITS} + (ascii(c) div {BANDS}) % {BAND_BITS}"
    return F.expr(f"aggregate(filter(split({word}, ''), c -> c <> ''), 0L, (m, c) -> m ^ shiftleft(1L, cast({bit} as int)))")


def _band(of: str, k: str) -> str:
    return f"(shiftright({of}, cast({BAND_BITS} * {k} as int)) & {(1 << BAND_BITS) - 1}L)"


def near_pairs(words: DataFrame) -> DataFrame:
    """a, an, b, bn for every two words of ``words`` (word, n; each word once) that differ by one inserted, deleted or replaced code point, once."""
    masked = words.withColumns({"size": F.length("word"), "mask": mask("word")})
    # a word stands in the class of its length (with words as long or one longer) and, as the longer one, in the class below
    places = F.expr(
        f"""inline(flatten(flatten(transform(array(size, size - 1), c -> transform(array({', '.join(map(str, range(BANDS)))}), k -> array(
          struct(c as class, k as band, 0 as half, xxhash64(c, k, 0, {_band('mask', 'k')}, substring(word, 1, c div 2)) as key),
          struct(c as class, k as band, 1 as half, xxhash64(c, k, 1, {_band('mask', 'k')}, right(word, c - c div 2)) as key)))))))"""
    )
    keys = masked.select("word", "n", "size", "mask", places)
    left = keys.where("class = size").select("key", "class", "band", "half", F.col("word").alias("a"), F.col("n").alias("an"), F.col("mask").alias("am"))
    right = keys.select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("size").alias("bsize"), F.col("mask").alias("bm"))
    first = "case " + " ".join(f"when {_band('am', str(k))} = {_band('bm', str(k))} then {k}" for k in range(BANDS - 1)) + f" else {BANDS - 1} end"
    once = F.expr(f"band = {first} and (half = 0 or substring(a, 1, class div 2) <> substring(b, 1, class div 2))")
    near = F.expr("(bsize = class + 1 or bsize = class and a < b) and bit_count(am ^ bm) <= 2 and levenshtein(a, b, 1) = 1")
    # the planner takes the places for as many rows as there are words and would broadcast them
    return left.hint("merge").join(right, "key").where(once & near).select("a", "an", "b", "bn")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (word, n).

    form: the near word of largest n (ties: the smallest in code-point order), if that is at least ``ratio`` times the word's
    n; root: where forms lead to, the word itself if it has none. No words give no rows.
    """
    spark = words.sparkSession
    known, known_path = write_table(words, "vocabulary")
    both = near_pairs(known).select(F.expr("inline(array(struct(a as word, b as near, bn as near_n), struct(b as word, a as near, an as near_n)))"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    accepted = -F.col("best.less") >= ratio * F.col("n")
    joined = known.hint("merge").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(accepted, F.col("best.near")).alias("form"), F.when(accepted, -F.col("best.less")).alias("form_n"))
    forms, _ = write_table(joined, "forms")
    drop_table(spark, known_path)
    # files of words are small beside the words in memory, so none of them is broadcast either;
    # each round doubles the steps taken; n grows at least ``ratio``-fold with each step, so few rounds do
    reached, path = write_table(forms.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not reached.where("moved").isEmpty():
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after, new = write_table(reached.hint("merge").join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_table(spark, path)
        reached, path = after, new
    return forms.hint("merge").join(reached.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: The same by deleted letters: near words are equal once a letter of one, or the same place of both, is gone.
OP12_SQL = rf"""
with recursive {sqltext.CRC_TABLE},
runs as (
  select doc_id, run, count(*) as c from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{LEAST_LENGTH},}}')) as run from documents)
  group by all),
hashed as (select run, c, {sqltext.crc32("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h from runs, crc_table),
words as (
  select word, cast(sum(c) as bigint) as n
  from (select c, case when h % {ONE_IN} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from hashed)
  where length(word) >= {LEAST_LENGTH} group by word having sum(c) >= {LEAST_TIMES}),
cut as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select c.word, w.word as other from cut c join words w on w.word = c.rest union select w.word, c.word from cut c join words w on w.word = c.rest
  union select a.word, b.word from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word),
best as (select r.word, count(*) as n_near, min({{'less': -w.n, 'near': w.word}}) as best from near r join words w on w.word = r.other group by r.word),
forms as (
  select w.word, n, coalesce(n_near, 0) as n_near, case when -best.less >= {RATIO} * n then best.near end as form, case when -best.less >= {RATIO} * n then -best.less end as form_n
  from words w left join best b on b.word = w.word),
steps as (select word, word as root, form from forms union all select s.word, s.form, f.form from steps s join forms f on f.word = s.form)
select f.word, f.form, s.root, f.n, f.n_near, f.form_n from forms f join steps s on s.word = f.word and s.form is null
"""
