import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from fathomweave.llm import variants
from fathomweave.llm.variants import OP12_SQL, grouped, near_pairs, op12_variants, vocabulary
from tests.llm.common import bag, empty, odd, odd_rows
from tests.oracle import assert_same

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows, one_in=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain(words):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def made(seed, n):
    """Words over few letters, so that many are near one another, with counts far apart."""
    r = random.Random(seed)
    return {"".join(r.choice("abé×") for _ in range(r.randint(6, 7))): 5 ** r.randint(1, 6) + r.randint(0, 9) for _ in range(n)}


def test_near_words_and_roots(spark):
    words = made(1, 900)
    assert len({w for w, f, r, *_ in plain(words) if f is not None and r != f}) > 3  # forms lead on
    assert bag(grouped(spark.createDataFrame(list(words.items()), "word string, n bigint")), *COLUMNS) == plain(words)


def test_each_pair_once(spark):
    words = made(2, 700)
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in near_pairs(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a < b and is_near(a, b))


def test_one_edit_flips_two_bits_at_most(spark):
    r = random.Random(3)
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    rows = []
    for _ in range(2000):
        w = [r.choice(letters) for _ in range(r.randint(6, 14))]
        i, what = r.randrange(len(w)), r.randrange(3)
        rows.append(("".join(w), "".join(w[:i] + ([r.choice(letters)] if what else []) + w[i + (what != 1) :])))
    df = spark.createDataFrame(rows, "a string, b string").select(F.bit_count(variants.mask("a").bitwiseXOR(variants.mask("b"))).alias("d"))
    assert df.agg(F.max("d")).first()[0] <= 2


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] * 3
    got = {r["word"]: r["n"] for r in vocabulary(odd(spark).union(odd(spark)).union(odd(spark))).collect()}
    assert got == plain_words(rows)
    assert bag(grouped(vocabulary(odd(spark))), *COLUMNS) == plain(plain_words([(r[0], r[1]) for r in odd_rows()]))


def test_no_rows(spark):
    assert grouped(vocabulary(empty(spark))).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    words = plain_words([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    got = {r["word"]: r["n"] for r in op12_variants(spark, sf).select("word", "n").collect()}
    assert got == words
    assert_same(spark, op12_variants, OP12_SQL, sf)


def test_places_are_not_broadcast(spark):
    """There are many of them for each word, which the planner's sizes don't show."""
    words, path = variants.write_table(spark.createDataFrame(list(made(4, 300).items()), "word string, n bigint"), "words")
    plan = near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    variants.drop_table(spark, path)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
