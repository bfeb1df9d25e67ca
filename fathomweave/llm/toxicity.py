"""Operator 7: toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word and of its character 4-grams, so endings
never seen in training still share a stem. Filters of several widths run over the word vectors; the largest
value of each filter in the whole text goes into a logistic unit. Gradients reach only the words where a
maximum lies. Training begins on the driver, on a bounded sample of labelled rows, and goes on over all labelled
rows, dealt into shards that tasks learn from side by side; what they learned is averaged. Scoring is one pass over the
texts, in blocks of words. Thresholds are calibrated on all labelled rows for each language, told from the text alone by
trees of byte pairs (operator 3), drawn towards the common one where a language has few rows, and folded into the score:
0.5 is the threshold everywhere. Runs of more than LONGEST
letters (scripts without spaces) are taken in pieces that overlap, each a word of its own, so all of a run counts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomweave.llm import langid
from fathomweave.llm.folds import held_out, sample_by_class
from fathomweave.runtime import held, let_go, ship

WORD = re.compile(r"\w+")
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
BLOCK = 1 << 17
KEPT_WORDS = 400_000
LONGEST, OVERLAP = 64, 16
#: So many rows of a language's rarer class weigh as much as the threshold of all languages.
POOLED = 5
PARTS = 3
#: So many labelled rows a shard has, about, and so many letters it learns from at a time.
SHARD, PIECE = 2048, 1 << 22
#: Thresholds are sought among multiples of 1 / GRID, no further than FAR from 0.
GRID, FAR = 256, 50


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; longer runs in pieces of LONGEST letters, so that terms of up to OVERLAP letters are whole in one."""
    found = WORD.findall(text.lower())
    if not found or max(map(len, found)) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, max(1, len(w) - OVERLAP), LONGEST - OVERLAP)]


def features(word: str) -> list[int]:
    """Rows of the embedding table for a word: itself and its 4-grams with its ends marked."""
    raw = f"<{word}>".encode("utf-8", "surrogatepass")
    return [zlib.crc32(raw, 1) & (BUCKETS - 1), *(zlib.crc32(raw[i : i + 4]) & (BUCKETS - 1) for i in range(len(raw) - 3))]


def _pair_codes(first: int) -> np.ndarray:
    """What two bytes (the first one high) add to the crc32 of four bytes in which they stand from ``first`` on."""
    ones = [np.array([zlib.crc32(bytes([b if k == at else 0 for k in range(4)])) for b in range(256)], np.uint32) for at in (first, first + 1)]
    return (ones[0][:, None] ^ ones[1][None, :] ^ np.uint32(zlib.crc32(bytes(4)))).ravel()


#: crc32 is linear: that of four bytes is made of those of its halves.
_HIGH, _LOW = _pair_codes(0), _pair_codes(2) ^ np.uint32(zlib.crc32(bytes(4)))


def all_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The :func:`features` of ``words`` (letters, digits, low lines) after one another, where those of each word begin, and how many it has."""
    if not words:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    raw = f"<{'><'.join(words)}>".encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts = np.flatnonzero(data == ord("<"))
    ends = np.append(starts[1:], len(data))
    size = np.maximum(ends - starts - 3, 0) + 1
    begin = np.cumsum(size) - size
    out = np.empty(begin[-1] + size[-1], np.int64)
    whole = np.zeros(len(out), bool)
    whole[begin] = True
    out[begin] = np.array([zlib.crc32(raw[a:b], 1) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64) & (BUCKETS - 1)
    pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
    # a window of four bytes lies in one word if none of its last three bytes begins another
    opens = data == ord("<")
    inside = ~(opens[1:-2] | opens[2:-1] | opens[3:])
    out[~whole] = (_HIGH[pairs[:-2][inside]] ^ _LOW[pairs[2:][inside]]) & np.uint32(BUCKETS - 1)
    return out, begin, size


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width (width * DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    languages: langid.PartialMatch | None = None
    mark: str = ""

    def vectors(self, words: list[str]) -> np.ndarray:
        rows, at, size = all_features(words)
        return np.add.reduceat(self.embedding[rows], at, axis=0) / size[:, None].astype(np.float32) ** 0.5

    def convolve(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width the values of its filters at each word; past the end of ``x`` there are zeros."""
        wide = np.concatenate([x, np.zeros((max(WIDTHS), DIM), np.float32)])
        return [np.maximum(np.concatenate([wide[k : k + len(x)] for k in range(w)], axis=1) @ f + b, 0) for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True)]

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias

    def parts(self) -> dict[str, np.ndarray]:
        """All that is learned, by the names that steps have."""
        dense = {f"{c}{k}": x for c, xs in (("f", self.filters), ("b", self.bias)) for k, x in enumerate(xs)}
        return {"embedding": self.embedding, "out": self.out, "out_bias": np.array([self.out_bias], np.float32), **dense}

    def rows(self) -> np.ndarray:
        """:meth:`parts` as rows of DIM numbers, those of the embedding first."""
        return _rows(self.parts())

    def from_rows(self, rows: np.ndarray) -> Network:
        """A network of this shape with other :meth:`rows`."""
        made, at = {}, 0
        for name, part in self.parts().items():
            n = -(-part.size // DIM)
            made[name] = rows[at : at + n].ravel()[: part.size].reshape(part.shape).astype(np.float32)
            at += n
        several = lambda c: [made[f"{c}{k}"] for k in range(len(WIDTHS))]
        return Network(made["embedding"], several("f"), several("b"), made["out"], float(made["out_bias"][0]))


def _rows(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.append(x.ravel(), np.zeros(-x.size % DIM, np.float32)).reshape(-1, DIM) for x in parts.values()])


def _new(seed: int) -> Network:
    r = np.random.default_rng(seed)
    return Network(
        (r.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32), [(r.standard_normal((w * DIM, FILTERS)) * (1 / (w * DIM)) ** 0.5).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], (r.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), 0.0,
    )


class _Steps:
    """Adagrad, in place."""

    def __init__(self, rate: float, sums: dict[str, np.ndarray] | None = None):
        self.rate, self.sums = rate, {k: x.copy() for k, x in (sums or {}).items()}

    def dense(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        s = self.sums.setdefault(name, np.full(value.shape, 1e-6, np.float32))
        s += grad * grad
        value -= self.rate * grad / np.sqrt(s)

    def rows(self, name: str, value: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        s = self.sums.setdefault(name, np.full(value.shape, 1e-6, np.float32))
        np.add.at(s, at, grad * grad)
        np.add.at(value, at, -self.rate * grad / np.sqrt(s[at]))


RATE = 0.15


def train(texts: list[str], labels: list[int], weights: list[float], epochs: int = 10, seed: int = 0, drop: float = 0.3, net: Network | None = None, step: _Steps | None = None) -> Network:
    """Logistic loss, one text at a time in a shuffled order, each time without a share ``drop`` of its words, so that no single word carries a text.

    ``net``, ``step``: where to begin; both are changed in place.
    """
    net, step, r = net or _new(seed), step or _Steps(RATE), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    flat, begin, length = all_features(list(vocabulary))
    size = length.astype(np.float32) ** 0.5
    out_bias = np.array([net.out_bias], np.float32)
    usable = [i for i, d in enumerate(docs) if len(d)]
    for _ in range(epochs):
        # the vectors of all words are worked out once an epoch and corrected where a gradient went
        vector = np.add.reduceat(net.embedding[flat], begin, axis=0) / size[:, None] if len(flat) else np.zeros((0, DIM), np.float32)
        for i in r.permutation(usable):
            keep = docs[i][r.random(len(docs[i])) >= drop] if drop else docs[i]
            keep = keep if len(keep) else docs[i]
            x = vector[keep]
            maps = net.convolve(x)
            tops = [m.argmax(axis=0) for m in maps]
            pooled = np.concatenate([m[t, np.arange(FILTERS)] for m, t in zip(maps, tops, strict=True)])
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + out_bias[0], -30, 30)))
            d = np.float32((p - labels[i]) * weights[i])
            if abs(d) < 1e-3:
                continue
            back = d * net.out * (pooled > 0)
            step.dense("out", net.out, d * pooled)
            step.dense("out_bias", out_bias, np.array([d], np.float32))
            where, grads = [], []
            for k, w in enumerate(WIDTHS):
                g, t = back[k * FILTERS : (k + 1) * FILTERS], tops[k]
                spans = t[:, None] + np.arange(w)
                inside = spans < len(x)
                window = np.where(inside[:, :, None], x[np.minimum(spans, len(x) - 1)], 0).reshape(FILTERS, w * DIM)
                dx = (g[:, None] * net.filters[k].T).reshape(FILTERS, w, DIM)
                step.dense(f"f{k}", net.filters[k], (window * g[:, None]).T)
                step.dense(f"b{k}", net.bias[k], g)
                live = inside & (g != 0)[:, None]
                where.append(keep[spans[live]])
                grads.append(dx[live])
            words, inverse = np.unique(np.concatenate(where), return_inverse=True)
            total = np.zeros((len(words), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            if len(words):
                own = length[words]
                first = np.cumsum(own) - own
                at = flat[np.repeat(begin[words] - first, own) + np.arange(first[-1] + own[-1])]
                step.rows("embedding", net.embedding, at, np.repeat(total / size[words, None], own, axis=0))
                vector[words] = np.add.reduceat(net.embedding[at], first, axis=0) / size[words, None]
    net.out_bias = float(out_bias[0])
    return net


def logits(net: Network, texts: list[str], cache: dict[str, int] | None = None, table: list | None = None) -> np.ndarray:
    """Of each text, in blocks of words; -inf for texts without a word. ``cache``, ``table``: words and vectors known from before."""
    cache, table = ({}, [np.zeros((1024, DIM), np.float32)]) if cache is None else (cache, table)
    found = np.full(len(texts), -np.inf)
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0
    fresh: list[str] = []  # the last words of the cache, whose vectors are still to be worked out

    def run() -> None:
        if fresh:
            table[0][len(cache) - len(fresh) : len(cache)] = net.vectors(fresh)
            fresh.clear()
        ids = np.concatenate([w for _, w in waiting])
        starts = np.cumsum([0, *(len(w) + max(WIDTHS) for _, w in waiting)])
        x = np.zeros((starts[-1], DIM), np.float32)
        at = np.concatenate([np.arange(s, s + len(w)) for s, (_, w) in zip(starts, waiting, strict=False)])
        x[at] = table[0][ids]
        bounds = np.stack([starts[:-1], starts[1:] - max(WIDTHS)], axis=1).ravel()  # the zeros between texts are left out
        pooled = np.concatenate([np.maximum.reduceat(m, bounds, axis=0)[::2] for m in net.convolve(x)], axis=1)
        for (i, _), value in zip(waiting, net.logit(pooled), strict=True):
            found[i] = max(found[i], value)

    for i, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        ids = list(map(cache.get, words))
        if None in ids:
            new = list(dict.fromkeys(w for w, k in zip(words, ids, strict=True) if k is None))
            if len(cache) + len(new) > KEPT_WORDS and cache:
                if waiting:
                    run()
                    waiting, size = [], 0
                cache.clear()
                new = list(dict.fromkeys(words))
            need = len(cache) + len(new)
            if need > len(table[0]):
                table[0] = np.concatenate([table[0], np.zeros((max(need, 2 * len(table[0])) - len(table[0]), DIM), np.float32)])
            fresh += new
            cache.update(zip(new, range(len(cache), need), strict=True))
            ids = list(map(cache.get, words))
        if size + len(ids) > BLOCK and waiting:
            run()
            waiting, size = [], 0
        waiting.append((i, np.array(ids, np.int64)))
        size += len(ids)
    if waiting:
        run()
    return found


BETA = 4.0


def calibrated(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold with the best F measure, midway between neighbours, but above all but two in a hundred of those labelled 0; ``weights``: how often each value is there.

    Recall counts BETA times as much as precision: a toxic text that stays costs more than a clean one that is looked at again.
    """
    order = np.argsort(-values, kind="stable")
    hits, all_ = np.cumsum((labels * weights)[order]), np.cumsum(weights[order])
    f1 = (1 + BETA**2) * hits / (all_ + BETA**2 * (labels * weights).sum())
    last = np.append(values[order][:-1] != values[order][1:], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = values[order][k + 1] if k + 1 < len(order) else values[order][k] - 2
    clean = order[::-1][labels[order[::-1]] == 0]
    least = -np.inf
    if len(clean):
        n = np.cumsum(weights[clean])
        least = values[clean][np.searchsorted(n, 0.98 * (n[-1] - 1), "right")]
    return float(max((values[order][k] + below) / 2, np.nextafter(least, np.inf)))


def _weights(truth: np.ndarray, positive: float) -> list[float]:
    """Both classes have the same weight in all if ``positive`` is the share of label 1."""
    return np.where(truth == 1, 0.5 / positive, 0.5 / (1 - positive)).tolist()


def _begun(sample: list[tuple[int, str, int]], seed: int) -> tuple[Network, _Steps, dict[int, float]]:
    """A network trained on ``sample`` (doc_id, text, label), its steps, and each text's value by a network that has not seen it."""
    truth = np.array([y for _, _, y in sample])
    if len(set(truth.tolist())) < 2:
        return _new(seed), _Steps(RATE), {}
    texts = [t for _, t, _ in sample]

    def balanced(rows: np.ndarray, step: _Steps | None = None) -> Network:
        return train([texts[i] for i in rows], truth[rows].tolist(), _weights(truth[rows], truth[rows].mean()), seed=seed, step=step)

    fold = np.array([zlib.crc32(f"{seed},{d}".encode()) % PARTS for d, _, _ in sample])
    judged = {}
    for k in range(PARTS):
        own = np.flatnonzero(fold == k)
        rest = np.flatnonzero(fold != k)
        rest = rest if len(set(truth[rest].tolist())) == 2 else np.arange(len(sample))
        judged |= zip([sample[i][0] for i in own], logits(balanced(rest), [texts[i] for i in own]).tolist(), strict=True)
    step = _Steps(RATE)
    return balanced(np.arange(len(sample)), step), step, judged


_MOVED = [f"m{i}" for i in range(DIM)]


def _pass(begun: tuple[Network, _Steps, dict[int, float]], positive: float):
    """Each shard (shard, doc_id, text, toxic; sorted) goes through training once, from where the sample left it.

    Gives what the shards of a task have learned: by row of the network the squares of its gradients (n) and, times these, how far it moved;
    and how many texts (n) of a language and label have a value, by the network of the sample or, if they are in it, by one without them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        first, steps, judged = begun.value
        origin, before = first.rows().astype(np.float64), _rows(_sums(steps, first)).sum(axis=1, dtype=np.float64)
        moved, energy, seen = np.zeros_like(origin), np.zeros(len(origin)), Counter()
        words: tuple[dict, list] = ({}, [np.zeros((1024, DIM), np.float32)])
        now, local, step = None, first, steps
        ids, texts, marks, size = [], [], [], 0

        def learn() -> None:
            nonlocal size
            if not texts:
                return
            values = [judged.get(d, v) for d, v in zip(ids, logits(first, texts, *words).tolist(), strict=True)]
            told = [x for x, _ in first.languages.predict_all([t.encode() for t in texts])] if first.languages else [""] * len(texts)
            seen.update(zip(told, marks, np.rint(np.clip(values, -FAR, FAR) * GRID).astype(int).tolist(), strict=True))
            train(texts, marks, _weights(np.array(marks), positive), epochs=1, net=local, step=step)
            ids.clear(), texts.clear(), marks.clear()
            size = 0

        def close() -> None:
            learn()
            if now is not None:
                gained = _rows(_sums(step, local)).sum(axis=1, dtype=np.float64) - before
                moved[:] += gained[:, None] * (local.rows() - origin)
                energy[:] += gained

        for batch in batches:
            for shard, doc_id, text, toxic in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, local, step = shard, first.from_rows(origin), _Steps(RATE, steps.sums)
                ids.append(doc_id)
                texts.append(text.as_py())
                marks.append(toxic)
                size += len(texts[-1])
                if size > PIECE:
                    learn()
        close()
        at = np.flatnonzero(energy)
        names = ["language", "toxic", "place", "n", *_MOVED]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(energy[at]), *map(pa.array, np.ascontiguousarray(moved[at].T))], names=names)
        rows = sorted(seen)
        cells = [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*cells, pa.array([seen[x] for x in rows], pa.float64()), *[pa.nulls(len(rows), pa.float64())] * DIM], names=names)

    return run


def _sums(step: _Steps, net: Network) -> dict[str, np.ndarray]:
    """The sums of squares of all parts of ``net``, those that had no step included."""
    return {k: step.sums.get(k, np.full(x.shape, 1e-6, np.float32)) for k, x in net.parts().items()}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, longest: int = 1 << 15, seed: int = 0) -> Network | None:
    """Trains on all labelled texts outside the held-out fold.

    First on the driver, for some epochs, on about ``per_class`` texts (of at most ``longest`` bytes) of each class; then each shard of about SHARD rows
    goes on from there for an epoch, and every row of the network moves by the mean of its moves in all shards, weighted by the squares of its
    gradients. Which rows share a shard, and their order in it, follows from doc_id alone. Thresholds come from the values of all labelled
    texts by networks that have not seen them. Rows of labels with a null toxic or doc_id are left out; of several texts of one doc_id one is taken; None
    if only one class is left.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''").where(~held_out())
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    one_text = F.min_by("text", F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), "text")))
    picked = sample_by_class(marked.withColumn("text", F.lit("")), "toxic", per_class).select("doc_id", "toxic")
    # one text for each id that was picked, however many rows share it
    sample = texts.where(f"octet_length(text) <= {longest}").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(one_text.alias("text"))
    begun = _begun(sorted((r["doc_id"], r["text"], r["toxic"]) for r in sample.collect()), seed)
    begun[0].languages = langid.fit_pairs(docs)

    count = sum(totals.values())
    shards = -(-count // SHARD)
    place = F.xxhash64("doc_id", F.lit(seed))
    rows = texts.select("doc_id", "text", F.lit(None).cast("int").alias("toxic")).unionByName(marked.select("doc_id", F.lit(None).cast("string").alias("text"), "toxic"))
    rows = rows.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), "doc_id", "text", "toxic").repartitionById(shards, "shard")
    whole = rows.groupBy("shard", "place", "doc_id").agg(one_text.alias("text"), F.max("toxic").alias("toxic")).where("text is not null and toxic is not null")
    whole = whole.sortWithinPartitions("shard", "place", "doc_id").select("shard", "doc_id", "text", "toxic")
    schema = "language string, toxic int, place int, n double, " + ", ".join(f"{m} double" for m in _MOVED)
    learned = whole.mapInArrow(_pass(spark.sparkContext.broadcast(begun), totals[1] / count), schema).groupBy("language", "toxic", "place").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in _MOVED])
    # a row for each row of the network, and for each language, label and multiple of 1 / GRID that occurs
    table = learned.toPandas()
    steps, seen = table[table["language"].isna()], table[table["language"].notna()].sort_values(["language", "toxic", "place"])
    if seen["toxic"].nunique() < 2:
        return None
    origin = begun[0].rows().astype(np.float64)
    origin[steps["place"].to_numpy(np.int64)] += steps[_MOVED].to_numpy() / steps[["n"]].to_numpy()
    net = begun[0].from_rows(origin)
    net.languages = begun[0].languages
    values, truth, n = seen["place"].to_numpy(np.float64) / GRID, seen["toxic"].to_numpy(np.int64), seen["n"].to_numpy(np.float64)
    net.threshold = calibrated(values, truth, n)
    for language in seen["language"].unique():
        own = (seen["language"] == language).to_numpy()
        least = min(n[own & (truth == y)].sum() for y in (0, 1))
        if least:
            share = least / (least + POOLED)
            net.thresholds[language] = float(share * calibrated(values[own], truth[own], n[own]) + (1 - share) * net.threshold)
    net.mark = uuid.uuid4().hex
    return net


def _scored(rows: DataFrame, net: Network | None) -> DataFrame:
    """row and score for ``rows`` (row: a struct that is passed on; text)."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        words = held(("words", net.mark), lambda: ({}, [np.zeros((1024, DIM), np.float32)])) if net is not None else None
        for batch in batches:
            found = np.zeros(batch.num_rows)
            at, chunk, size = [], [], 0

            def flush(at: list[int], chunk: list[str]) -> None:
                told = [x for x, _ in net.languages.predict_all([t.encode() for t in chunk])] if net.languages else [""] * len(chunk)
                for i, language, value in zip(at, told, logits(net, chunk, *words), strict=True):  # noqa: B023
                    if np.isfinite(value):
                        found[i] = 1 / (1 + np.exp(-np.clip(value - net.thresholds.get(language, net.threshold), -30, 30)))  # noqa: B023

            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py()
                if net is None or not text:
                    continue
                at.append(i)
                chunk.append(text)
                size += len(text)
                if size > 1 << 20:
                    flush(at, chunk)
                    at, chunk, size = [], [], 0
            if chunk:
                flush(at, chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Null texts and texts without a word score 0, as does every text where nothing could be learned; repeated
    rows are scored as often as they occur; other columns are ignored.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out")).alias("row"), F.col("text").cast("string").alias("text"))
    return _scored(rows, net).select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return _scored(rows, net).where("score < 0.5").select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
