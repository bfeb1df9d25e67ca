"""Phrases of a large lexicon in texts: whole words, all hits with places, in time that does not depend on their number.

A text is cut into words and what stands between them. A phrase that begins and ends with a word can only begin where a
word of the text does and end where one ends, so the runs of words that are as long as some phrase with that first word
are looked up, whole. A lexicon of up to HELD characters goes to every task; a larger one is joined by the runs' hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomweave.runtime import ship

#: Characters of the phrases that each task may hold.
HELD = 32 << 20
PIECE = re.compile(r"\w+|[^\w]+")


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else, so that places stay."""
    return text.encode().lower().decode()


def pieces(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is a word) of each piece of a text."""
    return [(m.start(), m.end(), text[m.start()].isalnum() or text[m.start()] == "_") for m in PIECE.finditer(text)]


def _runs(text: str, lengths: dict[str, list[int]] | None, every: list[int]) -> Iterator[tuple[int, int]]:
    """Start and end of the runs that may be phrases; ``lengths``: in pieces, by first word; without it, ``every`` length is tried."""
    found = pieces(text)
    for i, (start, end, word) in enumerate(found):
        if not word:
            continue
        for n in every if lengths is None else lengths.get(text[start:end], ()):
            if i + n <= len(found):
                yield start, found[i + n - 1][1]


def _shapes(column: pa.Array) -> dict[str, list[int]]:
    out: dict[str, set[int]] = {}
    for phrase in column.to_pylist():
        cut = pieces(phrase)
        out.setdefault(phrase[: cut[0][1]], set()).add(len(cut))
    return {w: sorted(ns) for w, ns in out.items()}


def hits(texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text", phrase: str = "phrase", held: int = HELD) -> DataFrame:
    """(key, phrase, start): every place (from 1) where a phrase of ``lexicon`` (phrase) stands in a text as whole words, in any case of A-Z.

    Phrases that differ in the case of A-Z alone are all hit. Phrases must begin and end with a word; others (and null) are left
    out: ``extract.matches`` finds those. Null texts have no hits; repeated rows have theirs again; repeated phrases count once.
    """
    spark = texts.sparkSession
    ship(spark)
    edge = r"(?U)^\w(.*\w)?$"
    known = lexicon.select(F.col(phrase).alias("phrase")).where(F.col("phrase").rlike("(?s)" + edge)).distinct().withColumn("low", F.translate("phrase", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    size = known.agg(F.sum(F.length("low"))).first()[0] or 0
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = texts.schema[key].dataType.simpleString()
    if size <= held:
        lows = known.select("low").distinct().toArrow().column(0)
        shared = spark.sparkContext.broadcast((_shapes(lows), frozenset(lows.to_pylist())))
        every: list[int] = []
    else:
        shared = spark.sparkContext.broadcast((None, None))
        cut = known.select("low").distinct().mapInArrow(_lengths, "n int").distinct()
        every = sorted(r[0] for r in cut.collect())  # lengths of phrases, in pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, names = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                low = lowered(batch.column(1)[i].as_py())
                found = [(low[s:e], s + 1) for s, e in _runs(low, shapes, every) if names is None or low[s:e] in names]
                if found:
                    keys = pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type)
                    lows, starts = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())
                    yield pa.RecordBatch.from_arrays([keys, lows, starts], names=["key", "low", "start"])

    found = rows.mapInArrow(run, f"key {kind}, low string, start int")
    return found.join(known, "low").select(F.col("key").alias(key), "phrase", "start")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted({len(pieces(p)) for p in batch.column(0).to_pylist()}), pa.int32())], names=["n"])
