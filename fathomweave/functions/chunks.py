"""Long texts in chunks of at most so many tokens: a table function for LATERAL, exact places, vectors weighted by tokens."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.functions import annotate
from fathomweave.functions.encode import shared_encoder
from fathomweave.runtime import ship

CHUNK = "chunk int, start int, length int, tokens int, text string"
_END = re.compile(r"[.!?]\s")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def counter(vocabulary: str) -> Callable[[str], int]:
    """Counts a text's tokens by a public vocabulary file; made once for each worker."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


def spans(text: str, most: int, count: Callable[[int, int], int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive parts of ``text`` of at most ``most`` tokens each (or one character); ``count``: the tokens of the part between two places.

    A part that is too long is cut after the sentence end nearest to its middle within 500 characters, else after the last newline
    before the middle, else after the last blank, else in the middle. Parts follow one another without a gap.
    """
    waiting = [(0, len(text))] if text else []
    while waiting:
        lo, hi = waiting.pop()
        tokens = count(lo, hi)
        if tokens <= most or hi - lo < 2:
            yield lo, hi, tokens
            continue
        mid = (lo + hi) // 2
        ends = [m.start() + 1 for m in _END.finditer(text, max(lo, mid - 500), min(hi, mid + 500))]
        if ends:
            at = min(ends, key=lambda e: abs(e - 1 - mid))
        else:
            found = text.rfind("\n", lo, mid)
            found = text.rfind(" ", lo, mid) if found < 0 else found
            at = found + 1 if found >= 0 else mid
        at = at if lo < at < hi else mid
        waiting += [(at, hi), (lo, at)]


class Chunks:
    """Table function: a row for each chunk of a text; null and empty texts have none."""

    def eval(self, text: str | None, most: int, vocabulary: str):
        for i, (lo, hi, tokens) in enumerate(spans(text or "", most, shared_encoder(vocabulary).between(text or ""))):
            yield i, lo + 1, hi - lo, tokens, text[lo:hi]


def register(spark: SparkSession, name: str = "chunks") -> None:
    """Makes ``lateral chunks(text, most, vocabulary)`` known to SQL."""
    ship(spark)
    spark.udtf.register(name, F.udtf(Chunks, returnType=CHUNK, useArrow=True))


def chunked(texts: DataFrame, key: str, text: str = "text", most: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """(key, chunk, start, length, tokens, text) of all chunks; start counts characters from 1."""
    spark = texts.sparkSession
    register(spark)
    texts.select(F.col(key).alias("key"), F.col(text).alias("whole")).createOrReplaceTempView("_texts_to_chunk")
    rows = spark.sql(f"select t.key, c.* from _texts_to_chunk t, lateral chunks(t.whole, {int(most)}, '{vocabulary or default_vocabulary()}') c")
    return rows.withColumnRenamed("key", key)


def facts(rows: DataFrame, key: str) -> DataFrame:
    """(key, chunks, total_tokens, max_tokens): what the metadata of a long text's vector says, from :func:`chunked`."""
    return rows.groupBy(key).agg(F.count("*").alias("chunks"), F.sum("tokens").alias("total_tokens"), F.max("tokens").alias("max_tokens"))


def pooled(rows: DataFrame, key: str, load: Callable | None = None) -> DataFrame:
    """(key, vector, chunks, total_tokens, max_tokens): the mean of the chunks' vectors weighted by their tokens, with :func:`facts`."""
    told = annotate.embed(rows, "text", "vector", load)
    parts = told.select(key, "tokens", F.posexplode("vector").alias("dim", "x")).groupBy(key, "dim").agg((F.sum(F.col("x").cast("double") * F.col("tokens")) / F.sum("tokens")).alias("mean"))
    vectors = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda d: d["mean"].cast("float")).alias("vector"))
    return facts(rows, key).join(vectors, key, "left").select(key, "vector", "chunks", "total_tokens", "max_tokens")
