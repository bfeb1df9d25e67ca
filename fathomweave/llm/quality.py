"""Operator 4: quality rules as a ledger of bits.

Every rule is evaluated once. The ledger keeps the measurements and, for each document, one integer whose
bit k says that rule k failed. A policy is a version and the bits it minds, so a new version is a bitwise
test on the ledger, and what each rule alone removes (an ablation) follows from counting the ledger's
distinct integers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]"
#: Bit, name, SQL that is true where the rule fails. Whole numbers only, so that each engine agrees.
RULES = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "short_words", "10 * word_chars < 20 * n_words"),
    (3, "long_words", "10 * word_chars > 150 * n_words"),
    (4, "symbols", "100 * n_symbols > 10 * n_words"),
    (5, "repeated_lines", "n_dup_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),  # a share of a few lines says nothing
    (6, "many_words", "n_words > 1000000"),
]
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


POLICIES = {"base": Policy("base", BASE), "v1": Policy("v1", 0b0111111), "v2": Policy("v2", 0b1111111)}
#: Places in a text that fit beside a 44-bit hash in one number; longer texts are sorted as pairs.
PLACE_BITS = 20


#: SQL: the hash of the window at place ``i`` of ``ws``.
DIGEST = "xxhash64(get(ws, i), get(ws, i + 1), get(ws, i + 2))"


def _repeated() -> str:
    """SQL: places (from 0) of the 3-word windows of ``ws`` that occur twice or more.

    Windows are sorted by hash, and neighbours of equal hash are held against one another word by word. Where two that differ share
    a hash, they may stand between equal ones, so such a text's windows are sorted by their words instead.
    """
    same = "get(ws, {a}) = get(ws, {b}) and get(ws, {a} + 1) = get(ws, {b} + 1) and get(ws, {a} + 2) = get(ws, {b} + 2)"
    grams = "transform(sequence(0, size(ws) - 3), i -> {as_})"
    text = "concat_ws(' ', get(ws, i), get(ws, i + 1), get(ws, i + 2))"
    beside = lambda k: f"coalesce(get(e, k + {k}).t = get(e, k).t, false)"
    by_words = f"get(transform(array(sort_array({grams.format(as_=f'struct({text} as t, i as i)')})), e -> transform(filter(sequence(0, size(e) - 1), k -> {beside(-1)} or {beside(1)}), k -> get(e, k).i)), 0)"

    def found(ordered: str, hash_of: str, place_of: str) -> str:
        alike = lambda k: f"{hash_of.format(x=f'get(s, k + {k})')} = {hash_of.format(x='get(s, k)')}"
        words = lambda k: same.format(a=place_of.format(x="get(s, k)"), b=place_of.format(x=f"get(s, k + {k})"))
        near = lambda k: f"coalesce({alike(k)} and {words(k)}, false)"
        mixed = f"exists(sequence(0, size(s) - 1), k -> coalesce({alike(1)} and not ({words(1)}), false))"
        return f"get(transform(array({ordered}), s -> if({mixed}, {by_words}, transform(filter(sequence(0, size(s) - 1), k -> {near(-1)} or {near(1)}), k -> {place_of.format(x='get(s, k)')}))), 0)"

    low = (1 << PLACE_BITS) - 1
    packed = found(f"sort_array({grams.format(as_=f'(({DIGEST} & ~{low}L) | i)')})", "({x} & ~" + f"{low}L)", f"cast({{x}} & {low}L as int)")
    pairs = found(f"sort_array({grams.format(as_=f'struct({DIGEST} as h, i as i)')})", "{x}.h", "{x}.i")
    return f"if(size(ws) < 3, cast(array() as array<int>), if(size(ws) <= {1 << PLACE_BITS}, {packed}, {pairs}))"


def measures(text: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text column, each a bigint; null counts as empty."""
    t = f"coalesce({text}, '')"
    words = f"filter(split({t}, '{SPACE}+'), w -> w <> '')"
    # arrays of one hold a value that a body reads many times, so that it's worked out once a row
    of_words = f"""get(transform(array({words}), ws -> struct(
        cast(size(ws) as bigint) as n_words,
        aggregate(ws, 0L, (n, w) -> n + length(w)) as word_chars,
        cast(size(array_distinct(flatten(transform({_repeated()}, i -> array(i, i + 1, i + 2))))) as bigint) as n_repeat_words)), 0)"""
    of_lines = f"""get(transform(array(filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')), ls -> struct(
        cast(size(ls) as bigint) as n_lines,
        cast(size(ls) - size(array_distinct(ls)) as bigint) as n_dup_lines)), 0)"""
    symbols = rf"cast(length({t}) - length(regexp_replace({t}, '[#*$%&|<>]', '')) as bigint)"
    return [F.expr(of_words).alias("of_words"), F.expr(of_lines).alias("of_lines"), F.expr(symbols).alias("n_symbols")]


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have zero words and fail ``few_words``; repeated rows stand as often as they
    occur; other columns are ignored. One pass, without a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.select("doc_id", *measures()).select("doc_id", "of_words.*", "of_lines.*", "n_symbols")
    bits = F.lit(0).cast("bigint")
    for bit, _, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return found.withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """Adds base_failed, kept and policy_version; kept is false if a base rule or one that the policy minds failed."""
    minded = F.col("fail_bits").bitwiseAND(F.lit(policy.mask | BASE).cast("bigint"))
    return book.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("bigint")) != 0).withColumn("kept", minded == 0).withColumn("policy_version", F.lit(policy.version))


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """rule, failed, only_this: for each rule of ``policy`` how many documents it fails, and how many are kept without it.

    The ledger is reduced to one row for each distinct fail_bits first (at most 2 to the number of rules).
    """
    masks = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bits = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("bigint").alias("bit")) for bit, name, _ in RULES if policy.mask >> bit & 1])
    each = masks.select("fail_bits", "n", F.inline(bits))
    minded = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    return each.groupBy("rule").agg(F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(minded == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), POLICIES["v1"]).drop("policy_version")


_BITS = " + ".join(f"case when {fails} then {1 << bit} else 0 end" for bit, _, fails in RULES)
_MINDED = " or ".join(f"({fails})" for bit, _, fails in RULES if (POLICIES["v1"].mask | BASE) >> bit & 1)
_BASE_SQL = " or ".join(f"({fails})" for bit, _, fails in RULES if BASE >> bit & 1)
OP4_SQL = rf"""
with words as (select doc_id, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from words),
places as (select doc_id, ws, unnest(range(len(ws) - 2)) as i from words where len(ws) >= 3),
windows as (select doc_id, i, ws[i + 1] as a, ws[i + 2] as b, ws[i + 3] as c from places),
again as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from windows),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again where n > 1) group by doc_id),
measured as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words, cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols
  from words w join lines l on l.doc_id = w.doc_id left join covered c on c.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_repeat_words, n_lines, n_dup_lines, n_symbols, cast({_BITS} as bigint) as fail_bits, ({_BASE_SQL}) as base_failed, not ({_MINDED}) as kept
from measured
"""
