"""Operator 3: language identification by prediction by partial matching.

For each language a tree of byte contexts up to a given order is counted on sample texts and then frozen. A
byte costs the bits of its frequency in the longest context seen, or of an escape from it (method C: as
many escapes as different bytes were seen there) and then of the next shorter context, down to equal
shares of the 256 bytes. The language whose tree codes the whole text in the fewest bits wins. A tree holds
the contexts that were seen and nothing else, as sorted arrays, so neither the number of languages nor that of
different bytes changes its order; the distinct windows of a block of texts are looked up once for each language.
Trees of one byte of context (:func:`fit_pairs`) are counted on all texts by Spark and looked up in a table of all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.llm.folds import held_out, sample_by_class
from fathomweave.runtime import let_go, ship

LETTER = re.compile(r"[^\W\d_]")
MOST_ORDER = 7
BLOCK = 1 << 19
UNDETERMINED = "und"
PAIRS = 1 << 16


@dataclass
class Tree:
    """For contexts of 0, 1, ... bytes: windows (context and byte) seen, with their bits; contexts seen, with the bits of an escape."""

    windows: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def cost(self, windows: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each window, in bits."""
        out = np.zeros(len(windows))
        left = np.arange(len(windows))
        for k in reversed(range(len(self.windows))):
            key = _shorter(windows[left], k)
            at, hit = _find(self.windows[k], key)
            out[left[hit]] += self.bits[k][at[hit]]
            left, key = left[~hit], key[~hit]
            at, known = _find(self.contexts[k], key >> key.dtype.type(8))
            out[left[known]] += self.escapes[k][at[known]]
        out[left] += 8
        return out


def _shorter(windows: np.ndarray, k: int) -> np.ndarray:
    """The last byte of each window after its last ``k`` ones."""
    return windows & windows.dtype.type((1 << 8 * (k + 1)) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _windows(data: np.ndarray, order: int) -> np.ndarray:
    """Each byte of ``data`` from the one at ``order`` on, after the ``order`` bytes before it, as one number."""
    n = len(data) - order
    out = np.zeros(n, np.uint32 if order < 4 else np.uint64)
    for back in range(order, -1, -1):
        out = out << out.dtype.type(8) | data[order - back : order - back + n]
    return out


@dataclass
class PartialMatch:
    """languages, the tree of each, and how many bytes its longest contexts have; blanks stand before a text."""

    languages: list[str]
    trees: list[Tree]
    order: int
    pairs: list[np.ndarray] | None = None  # of trees of order 1, once a text was told: the cost of every pair of bytes

    def code_lengths(self, texts: list[bytes], lead: bytes | None = None) -> np.ndarray:
        """(texts, languages): bits of each of ``texts``, none of them empty; ``lead``: the ``order`` bytes before each."""
        lead = b" " * self.order if lead is None else lead
        data = np.frombuffer(lead.join([b"", *texts]), np.uint8)
        if self.order == 1:
            self.pairs = self.pairs or [t.cost(np.arange(PAIRS, dtype=np.uint32)) for t in self.trees]
            costs, place = self.pairs, _windows(data, 1)
        else:
            windows, place = np.unique(_windows(data, self.order), return_inverse=True)
            costs = (t.cost(windows) for t in self.trees)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + self.order) - sizes - self.order
        # what ends in the lead of the next text is no byte of a text
        ends = np.stack([starts, starts + sizes], axis=1).ravel()
        return np.stack([np.add.reduceat(np.append(c[place], 0.0), ends)[::2] for c in costs], axis=1)

    def predict(self, text: bytes) -> tuple[str, float]:
        """The language and its share of the likelihood, flattened since bytes of a word are far from independent."""
        total = np.zeros(len(self.languages))
        text = b" " * self.order + text
        for at in range(self.order, len(text), BLOCK):
            total += self.code_lengths([text[at : at + BLOCK]], text[at - self.order : at])[0]
        return self.verdict(total)

    def predict_all(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """:meth:`predict` for each of ``texts``, none of them empty, in blocks."""
        found: list[tuple[str, float]] = []
        waiting: list[bytes] = []
        size = 0
        for text in texts:
            if waiting and size + len(text) > BLOCK:
                found += map(self.verdict, self.code_lengths(waiting))
                waiting, size = [], 0
            if len(text) > BLOCK:
                found.append(self.predict(text))
                continue
            waiting.append(text)
            size += len(text)
        return found + [self.verdict(x) for x in self.code_lengths(waiting)] if waiting else found

    def verdict(self, total: np.ndarray) -> tuple[str, float]:
        best = int(np.argmin(total))
        return self.languages[best], float(1 / np.exp2(np.maximum(-1000, (total[best] - total) / 4)).sum())


def train(samples: dict[str, list[bytes]], order: int = 3) -> PartialMatch:
    """Counts the tree of each language on its texts; ``order``: 0 to 7 bytes."""
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 0 to {MOST_ORDER}")
    languages = sorted(samples)
    trees = []
    for language in languages:
        # one text at a time, so that no window spans two
        found = [np.unique(_windows(np.frombuffer(b" " * order + t, np.uint8), order), return_counts=True) for t in samples[language] if t]
        windows, place = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
        trees.append(_tree(windows, np.bincount(place, np.concatenate([n for _, n in found])), order))
    return PartialMatch(languages, trees, order)


def _tree(windows: np.ndarray, counts: np.ndarray, order: int) -> Tree:
    """From the distinct windows of ``order`` bytes of context and how often each was seen."""
    tree = Tree([], [], [], [])
    for k in range(order + 1):
        seen, place = np.unique(_shorter(windows, k), return_inverse=True)
        n = np.bincount(place, counts)
        contexts, place = np.unique(seen >> seen.dtype.type(8), return_inverse=True)
        kinds = np.bincount(place)
        all_ = np.bincount(place, n) + kinds
        tree.windows.append(seen)
        tree.bits.append(-np.log2(n / all_[place]))
        tree.contexts.append(contexts)
        tree.escapes.append(-np.log2(kinds / all_))
    return tree


def _pair_counts(texts: list[bytes]) -> np.ndarray:
    """How often each pair of bytes stands in ``texts``, none of them empty, a blank before each."""
    data = np.frombuffer(b" ".join([b"", *texts]), np.uint8)
    # no pair spans two texts
    between = np.array([t[-1] << 8 | ord(" ") for t in texts[:-1]], np.int64)
    return np.bincount(_windows(data, 1), minlength=PAIRS) - np.bincount(between, minlength=PAIRS)


def fit_pairs(docs: DataFrame) -> PartialMatch | None:
    """Learns trees of one byte of context from every row with a language and a text outside the held-out fold; None if there is none.

    A task counts the pairs of its texts; the driver sees at most PAIRS sums of each language.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> None:
            for language, texts in waiting.items():
                sums[language] = sums.get(language, 0) + _pair_counts(texts)
            waiting.clear()

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                waiting.setdefault(language, []).append(text.as_py().encode())
                size += len(waiting[language][-1])
                if size > BLOCK:
                    flush()
                    size = 0
        flush()
        for language, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "pair", "n"])

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    rows = rows.where("doc_id is not null and lang is not null and text <> ''").where(~held_out()).select("lang", "text")
    told = rows.mapInArrow(run, "lang string, pair int, n bigint").groupBy("lang", "pair").agg(F.sum("n").alias("n")).toPandas()
    trees = {language: _tree(own["pair"].to_numpy(np.uint32), own["n"].to_numpy(), 1) for language, own in told.sort_values(["lang", "pair"]).groupby("lang")}
    return PartialMatch(list(trees), list(trees.values()), 1) if trees else None


def fit(docs: DataFrame, per_language: int = 500, longest: int = 1 << 16, order: int = 3) -> PartialMatch | None:
    """Learns from a sample of about ``per_language`` texts (of at most ``longest`` bytes) of each language outside the held-out fold.

    None if no such row has a language and a text.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null and text is not null").where(~held_out()).where(f"octet_length(text) between 1 and {longest}")
    samples: dict[str, list[bytes]] = {}
    for r in sample_by_class(rows, "lang", per_language).select("lang", "text").toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return train(samples, order) if samples else None


def identify(docs: DataFrame, model: PartialMatch | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text).

    ``und`` with score 0 for null texts, texts without a letter and, where nothing was learned, all texts;
    repeated rows are scored as often as they occur; other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def verdicts(texts: list[bytes]) -> list[tuple[str, float]]:
            if len(texts) == 1:
                return [model.predict(texts[0])]
            return [model.verdict(x) for x in model.code_lengths(texts)]

        for batch in batches:
            found: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * batch.num_rows
            waiting: list[tuple[int, bytes]] = []
            size = 0
            for i, cell in enumerate(batch.column(2)):
                text = cell.as_py()
                if model is None or text is None or not LETTER.search(text):
                    continue
                raw = text.encode()
                if waiting and size + len(raw) > BLOCK:
                    for (j, _), v in zip(waiting, verdicts([t for _, t in waiting]), strict=True):
                        found[j] = v
                    waiting, size = [], 0
                waiting.append((i, raw))
                size += len(raw)
            if waiting:
                for (j, _), v in zip(waiting, verdicts([t for _, t in waiting]), strict=True):
                    found[j] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v[0] for v in found], pa.string()), pa.array([v[1] for v in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
