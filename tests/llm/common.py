"""A table with what can go wrong in it: nulls in each column, empty, blank, one-word and very long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, place bigint, score double, row string, fp bigint, _text string, size bigint"
WORDS = "the of and to in alpha beta gamma delta omega river stone cloud winter summer train letter window garden music paper silver copper forest".split()


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = words(120, 1)
    texts = [base, base, base.replace("river", "lake", 1), base.upper(), None, None, "", "   \n\t ", "word", "two words", "a b c", words(300, 2), words(300, 2) + " tail", "###$$$ %%%", "line one\nline one\n\nline two", "日本語 テキスト é ü", words(60000, 3), "x" * 200000]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[4], (None, base, "en", "s0", 1), (None, None, None, None, None), (11, words(40, 9), "de", "s1", 7)]
    return [(*r, 7, 0.5, "row", 1, "t", 3) for r in rows]


def odd(spark, n: int | None = None):
    return spark.createDataFrame(odd_rows()[:n], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns) -> list:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
