"""Hooks for models, each with a deterministic stand-in, and the chunker for long texts."""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomweave.runtime import ship

LONG_TEXT = 16384


def hashed_vector(text: str, dims: int = 64) -> list[float]:
    """Words hashed to signed dimensions, of length 1; the stand-in for an encoder."""
    v = np.zeros(dims)
    for w in re.findall(r"\w+", text.lower()):
        h = zlib.crc32(w.encode())
        v[h % dims] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


#: Words whose places are remembered at most.
_REMEMBERED = 1 << 18
#: Longer words are hashed one by one.
_LONG_WORD = 64
_WORD = np.array([chr(i).isalnum() or chr(i) == "_" for i in range(128)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


class _Places(dict):
    """Place of a word among ``2 * dims``: its dimension, in the second half if its sign is plus."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        place = h % self.dims + (self.dims if h >> 16 & 1 else 0)
        if len(self) < _REMEMBERED:
            self[word] = place
        return place


def _plain_places(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each ASCII text, and the places of all of them; the CRC-32 of all words is carried on a letter at a time."""
    raw = "\n".join(texts).lower().encode()
    letters = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(letters) + 2, bool)
    inside[1:-1] = _WORD[letters]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    sizes = np.diff(np.searchsorted(starts, bounds))
    order = np.argsort(-np.minimum(lengths, _LONG_WORD + 1).astype(np.int8), kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    # words of n letters or more stand before the others
    longest = int(left[0]) if len(left) else 0
    reach = len(left) - np.searchsorted(left[::-1], np.arange(min(longest, _LONG_WORD)), side="right")
    for k, n in enumerate(reach.tolist()):
        crc[:n] = _CRC[(crc[:n] ^ letters[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    crc = ~crc
    for i in np.flatnonzero(lengths[order] > _LONG_WORD).tolist():
        crc[i] = zlib.crc32(raw[at[i] : at[i] + left[i]])
    places = np.empty(len(crc), np.int64)
    places[order] = crc % dims + dims * (crc >> 16 & 1)
    return sizes, places


def hashed_vectors(texts: list[str], places: _Places) -> np.ndarray:
    """:func:`hashed_vector` of many texts at once, a row each; ``places`` is kept from call to call."""
    out = np.zeros((len(texts), places.dims))
    plain, other = [i for i, t in enumerate(texts) if t.isascii()], [i for i, t in enumerate(texts) if not t.isascii()]
    for rows in (plain, other):
        if not rows:
            continue
        if rows is plain:
            sizes, at = _plain_places([texts[i] for i in rows], places.dims)
        else:
            words = [re.findall(r"\w+", texts[i].lower()) for i in rows]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            at = np.fromiter((places[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        at = at + np.repeat(np.arange(len(rows)) * (2 * places.dims), sizes)
        counts = np.bincount(at, minlength=len(rows) * 2 * places.dims).reshape(len(rows), 2, places.dims)
        v = (counts[:, 1] - counts[:, 0]).astype(np.float64)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        out[rows] = v / np.where(n > 0, n, 1.0)
    return out


def split_tokens(text: str, most: int, count: Callable[[str], int] = lambda t: len(t.split())) -> list[str]:
    """Halves the text until each part has at most ``most`` tokens: at the sentence end nearest to the middle within 500 characters, else at the last newline, else the last blank before it, else in the middle."""
    if count(text) <= most or len(text) < 2:
        return [text] if text.strip() else []
    mid = len(text) // 2
    lo, hi = max(0, mid - 500), min(len(text), mid + 500)
    ends = [lo + m.end() for m in re.finditer(r"[.!?]\s", text[lo:hi])]
    at = min(ends, key=lambda e: abs(e - mid)) if ends else text.rfind("\n", 0, mid) if "\n" in text[:mid] else text.rfind(" ", 0, mid) if " " in text[:mid] else mid
    at = at if 0 < at < len(text) else mid
    return split_tokens(text[:at].strip(), most, count) + split_tokens(text[at:].strip(), most, count)


def chunk_column(text: Column, most: int = 4096) -> Column:
    """Array of chunks of a text column."""
    ship(SparkSession.active())

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_tokens(t, most) if t else [])

    return run(text)


def _vectors(texts: list[str | None], encode: Callable[[list[str]], Sequence[Sequence[float]]]) -> pa.Array:
    """A vector of floats for each text, null for null; of a long text the mean of those of its parts."""
    known = [t for t in texts if t is not None]
    parts = [[t] if len(t) <= LONG_TEXT else split_tokens(t, 4096) or [t] for t in known]
    made, at, rows = np.asarray(encode([x for ps in parts for x in ps]) if parts else []), 0, []
    for ps in parts:
        rows.append(made[at] if len(ps) == 1 else np.mean(made[at : at + len(ps)], axis=0))
        at += len(ps)
    values = np.concatenate(rows).astype(np.float32) if rows else np.zeros(0, np.float32)
    lengths = iter(map(len, rows))
    ends = np.cumsum([0] + [0 if t is None else next(lengths) for t in texts])
    missing = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), pa.list_(pa.float32()), mask=missing)


#: So many characters go to an encoder at once, or one text.
_AT_ONCE = 1 << 22


def _portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > _AT_ONCE and i > first:
            yield texts[first:i]
            first, held = i, len(t or "")
    yield texts[first:]


def embed(df: DataFrame, text: str, out: str, load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """Adds a vector column; ``load`` makes the encoder once for each worker. Long texts are split and their vectors averaged; null stays null."""
    return embed_all(df, {out: F.col(text)}, load)


def embed_all(df: DataFrame, texts: dict[str, Column], load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """As :func:`embed`, a vector column for each text, all in one pass."""
    ship(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _Places(64)
        encode = load() if load else lambda ts: hashed_vectors(ts, places)
        for batch in batches:
            made = [_vectors(few, encode) for few in _portions(batch.to_pylist())]
            yield made[0] if len(made) == 1 else pa.concat_arrays(made)

    return df.withColumns({out: run(text) for out, text in texts.items()})


def answers(df: DataFrame, prompt: Column, out: str, load: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Adds what a text model answers to a prompt column."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield pd.Series(model(list(prompts)))

    return df.withColumn(out, run(prompt))


TOKEN = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("lemma", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("dep", T.StringType()), T.StructField("head", T.IntegerType())]))
ENTITY = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("score", T.DoubleType())]))


def plain_parse(text: str, verbs: list[str]) -> list[tuple]:
    """Stand-in for a dependency parser: in each sentence a known verb takes the nearest capitalised word on either side as subject and object."""
    forms = {f: v for v in verbs for f in (v, v + "s", v + "es", v + "ed", v + "ing", v.removesuffix("e") + "ed", v.removesuffix("e") + "ing")} | {"sent": "send"}
    out: list[tuple] = []
    for sentence in re.split(r"[.!?]", text):
        words = re.findall(r"[^\s,;:()]+", sentence)
        first = len(out)
        tokens = [[first + k, w, forms.get(w.lower(), w.lower()), "VERB" if w.lower() in forms else "NOUN", "dep", first + k] for k, w in enumerate(words)]
        named = [k for k, t in enumerate(tokens) if t[3] == "NOUN" and t[1][0].isupper()]
        for k in (k for k, t in enumerate(tokens) if t[3] == "VERB"):
            for dep, near in (("nsubj", max((x for x in named if x < k), default=None)), ("dobj", min((x for x in named if x > k), default=None))):
                if near is not None and tokens[near][4] == "dep":
                    tokens[near][4:] = [dep, first + k]
        out += map(tuple, tokens)
    return out


def plain_recognise(text: str) -> list[tuple[str, float]]:
    """Stand-in for an entity recogniser: words of capitals, digits and marks, with a score of 1."""
    return [(w, 1.0) for w in re.findall(r"(?<![\w-])[A-Z][A-Z0-9_-]+\*?(?![\w-])", text)]


def _mapped(df: DataFrame, text: str, out: str, kind: T.DataType, load: Callable[[], Callable[[str], list]]) -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else model(t))

    return df.withColumn(out, run(F.col(text)))


def parse(df: DataFrame, text: str, out: str, verbs: list[str], load: Callable[[], Callable[[str], list]] | None = None) -> DataFrame:
    """Adds a text's tokens (i, word, lemma, pos, dep, head: i of the token it hangs on); ``load`` makes the parser once for each worker."""
    return _mapped(df, text, out, TOKEN, load or (lambda: lambda t: plain_parse(t, verbs)))


def recognise(df: DataFrame, text: str, out: str, load: Callable[[], Callable[[str], list]] | None = None) -> DataFrame:
    """Adds what an entity recogniser finds in a text (word, score); ``load`` makes it once for each worker."""
    return _mapped(df, text, out, ENTITY, load or (lambda: lambda t: plain_recognise(t)))


def first_available(loaders: list[Callable[[], Callable]], probe: object) -> Callable[[], Callable]:
    """A loader that takes the first of ``loaders`` whose model can be made and answers ``probe``; the errors of others become warnings.

    Raises RuntimeError where none can, so that no row goes without an answer unnoticed.
    """

    def load() -> Callable:
        for place, one in enumerate(loaders):
            try:
                model = one()
                model(probe)
            except Exception as e:  # a model may fail in any way; the next one is tried
                warnings.warn(f"model {place} can't be used: {type(e).__name__}: {e}", stacklevel=2)
            else:
                return model
        raise RuntimeError("no model can be used")

    return load
