"""A sequence tagger for names: an averaged perceptron over words, decoded by Viterbi.

It learns from lexicon hits in a bounded sample of sentences. Half of the hits are masked (replaced by made-up names), so what stands
around a name counts and names that no list holds are found as well. It takes the place of a recogniser in
``annotate.recognise``; features are hashed by CRC, so training is the same everywhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomweave.operators import phrases

BUCKETS = 1 << 16
#: Sentences that a model is fitted on, and passes over them.
SAMPLE, ROUNDS = 4000, 5
OUTSIDE = "O"
_TOKEN = re.compile(r"[\w*-]+|[^\w\s]")


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _shape(word: str) -> str:
    one = "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", one)


def features(words: list[str], i: int) -> list[int]:
    """Hashed features of word ``i``: itself, its shape and ends, and its neighbours."""
    w = words[i]
    at = lambda k: words[i + k] if 0 <= i + k < len(words) else "<>"
    said = [f"w={w.lower()}", f"s={_shape(w)}", f"e={w[-3:].lower()}", f"b={w[:2].lower()}", f"p={at(-1).lower()}", f"n={at(1).lower()}", f"pp={at(-2).lower()}", f"nn={at(2).lower()}", f"ps={_shape(at(-1))}", f"ns={_shape(at(1))}", f"pn={at(-1).lower()}|{at(1).lower()}"]
    return [zlib.crc32(x.encode()) % BUCKETS for x in said]


@dataclass
class Tagger:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    moves: np.ndarray  # labels x labels, from x to

    def scores(self, words: list[str]) -> np.ndarray:
        return np.array([self.weights[features(words, i)].sum(0) for i in range(len(words))]).reshape(len(words), len(self.labels))

    def decode(self, words: list[str]) -> list[int]:
        return viterbi(self.scores(words), self.moves) if words else []

    def names(self, text: str) -> list[tuple[str, str]]:
        """(name, type) in the order of the text; neighbouring words of one type that go on (I-) are one name."""
        spans = tokens(text)
        told = self.decode([text[a:b] for a, b in spans])
        out: list[list] = []
        for (a, b), k in zip(spans, told, strict=True):
            label = self.labels[k]
            if label.startswith("B-") or label.startswith("I-") and not (out and out[-1][3] and out[-1][2] == label[2:]):
                out.append([a, b, label[2:], True])
            elif label.startswith("I-"):
                out[-1][1] = b
            elif out:
                out[-1][3] = False
        return [(text[a:b], kind) for a, b, kind, _ in out]


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The sequence of labels with the largest sum of scores and moves; ties go to the smaller label."""
    best, back = scores[0], []
    for row in scores[1:]:
        all_ = best[:, None] + moves
        back.append(all_.argmax(0))
        best = all_.max(0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def train(sentences: list[tuple[list[str], list[str]]], rounds: int = ROUNDS, seed: int = 0) -> Tagger:
    """An averaged perceptron from (words, labels)."""
    labels = [OUTSIDE, *sorted({y for _, ys in sentences for y in ys} - {OUTSIDE})]
    number = {y: k for k, y in enumerate(labels)}
    model = Tagger(labels, np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels))))
    summed, summed_moves, step = np.zeros_like(model.weights), np.zeros_like(model.moves), 1
    data = [([features(ws, i) for i in range(len(ws))], [number[y] for y in ys]) for ws, ys in sentences if ws]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for s in rng.permutation(len(data)):
            rows, gold = data[s]
            told = viterbi(np.array([model.weights[r].sum(0) for r in rows]), model.moves)
            for i, (g, t) in enumerate(zip(gold, told, strict=True)):
                if g != t:
                    for k, by in ((g, 1), (t, -1)):
                        np.add.at(model.weights, (rows[i], k), by)
                        np.add.at(summed, (rows[i], k), by * step)
                if i and (gold[i - 1], g) != (told[i - 1], t):
                    for a, b, by in ((gold[i - 1], g, 1), (told[i - 1], t, -1)):
                        model.moves[a, b] += by
                        summed_moves[a, b] += by * step
            step += 1
    # the mean of the weights over all steps
    model.weights -= summed / step
    model.moves -= summed_moves / step
    return model


def labelled(text: str, hits: list[tuple[int, int, str]]) -> tuple[list[str], list[str]]:
    """Words and labels of a text whose ``hits`` are (start from 0, end, type); of hits that overlap the first and longest counts."""
    spans = tokens(text)
    ys, free = [OUTSIDE] * len(spans), 0
    for start, end, kind in sorted(hits, key=lambda h: (h[0], -h[1])):
        own = [i for i, (a, b) in enumerate(spans) if start <= a and b <= end]
        if own and own[0] >= free:
            for k, i in enumerate(own):
                ys[i] = f"{'I' if k else 'B'}-{kind}"
            free = own[-1] + 1
    return [text[a:b] for a, b in spans], ys


def masked(words: list[str], labels: list[str], seed: int) -> tuple[list[str], list[str]]:
    """The same with every name replaced by letters of its shape that a hash draws."""
    rng = np.random.default_rng(zlib.crc32(f"{seed}:{' '.join(words)}".encode()))
    draw = lambda c: chr(rng.integers(65, 91)) if c.isupper() else chr(rng.integers(97, 123)) if c.islower() else c
    return ["".join(map(draw, w)) if y != OUTSIDE else w for w, y in zip(words, labels, strict=True)], labels


def sample(sentences: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text", most: int = SAMPLE) -> list[tuple[list[str], list[str]]]:
    """Words and labels of at most twice ``most`` sentences, chosen by a hash of the text; lexicon: phrase, entity_type."""
    n = sentences.where(F.col(text).isNotNull()).count()
    chosen = sentences.where(F.col(text).isNotNull()).where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) <= F.lit(int((1 << 20) * min(1.0, most / max(1, n))))).select(key, text).limit(2 * most)
    rows = {r[key]: r[text] for r in chosen.collect()}
    found: dict[object, list] = {}
    kept = sentences.sparkSession.createDataFrame(list(rows.items()), sentences.select(key, text).schema)
    for r in phrases.hits(kept, lexicon, key, text).join(lexicon, "phrase").collect():
        found.setdefault(r[key], []).append((r["start"] - 1, r["start"] - 1 + len(r["phrase"]), r["entity_type"]))
    return [labelled(t, found.get(k, [])) for k, t in sorted(rows.items(), key=lambda x: x[1])]


def fit(sentences: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text", most: int = SAMPLE, rounds: int = ROUNDS, seed: int = 0) -> Tagger:
    """A tagger from the lexicon's hits in a bounded sample, each sentence as it is and masked."""
    known = sample(sentences, lexicon, key, text, most)
    return train(known + [masked(*s, seed) for s in known], rounds, seed)


def loader(model: Tagger) -> Callable[[], Callable[[str], list[tuple[str, float]]]]:
    """For ``annotate.recognise``: the names of a text with a score of 1."""
    return lambda: lambda text: [(name, 1.0) for name, _ in model.names(text)]
