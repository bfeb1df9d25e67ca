"""An inverted-file index over vectors: cells by k-means, residuals in a few bytes, exact re-ranking.

Vectors are scaled to length one. Centroids and the code books of the residuals' pieces are fitted on a bounded sample;
every row is indexed. Each distinct vector is stored once, in the partition of its cell, as code and in full; the rows that
have it are a table of their own, so a vector that a third of all rows share costs what any other does.

Beside its code a vector keeps how far the code is from it. By the inequality of Cauchy and Schwarz the true score lies
within that distance of the score of the code, so a search can tell from the codes which vectors may be among the
best: only these are read in full. With all cells looked at, the answer is that of the full scan; with the nearest
``probes`` cells of each query it is the best of these cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.functions import vectors as vx
from fathomweave.runtime import drop_table, ship, shuffle_partitions, write_table

#: Rows that the model is fitted on at most, entries of a code book (a code is one byte), rows of a packed block, queries of a block.
SAMPLE, BOOK, PACKED, QUERIES = 1 << 16, 256, 1024, 64
MOST_CELLS = 4096
#: Of the sums of products, in double.
SLACK = 1e-9
#: Vectors without a direction (zero, no numbers, another length): their score is 0 with any query.
NOWHERE = -1


@dataclass
class Model:
    centroids: np.ndarray  # cells x dim
    books: np.ndarray  # pieces x BOOK x (dim / pieces)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def unit(self, vectors: list[list[float] | None]) -> np.ndarray:
        """Vectors of length one; zeros for those without a direction."""
        out = np.zeros((len(vectors), self.dim))
        for i, v in enumerate(vectors):
            if v is not None and len(v) == self.dim and None not in v:
                a = np.array(v, float)
                n = np.sqrt((a * a).sum())
                if np.isfinite(n) and n > 0:
                    out[i] = a / n
        return out

    def cell(self, units: np.ndarray) -> np.ndarray:
        near = (units @ self.centroids.T - (self.centroids**2).sum(1) / 2).argmax(1) if len(units) else np.zeros(0, int)
        return np.where(units.any(1), near, NOWHERE)

    def encode(self, units: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of what they stand for from the vectors."""
        rest = units - self.centroids[np.maximum(cells, 0)]
        pieces, _, width = self.books.shape
        codes = np.stack([nearest(rest[:, p * width : (p + 1) * width], self.books[p]) for p in range(pieces)], 1).astype(np.uint8)
        told = np.concatenate([self.books[p][codes[:, p]] for p in range(pieces)], 1)
        return codes, np.sqrt(((rest - told) ** 2).sum(1))

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Scores of the codes of one cell, queries x codes, by one table of products for each query and piece."""
        pieces, _, width = self.books.shape
        out = np.repeat((queries @ self.centroids[cell])[:, None], len(codes), 1)
        for p in range(pieces):
            out += (queries[:, p * width : (p + 1) * width] @ self.books[p].T)[:, codes[:, p]]
        return out


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(rows[i : i + 8192] @ centres.T - half).argmax(1) for i in range(0, len(rows), 8192)] or [np.zeros(0, int)])


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """``k`` centres (some may be alike where rows are few); one that loses all its rows moves to the row that is worst off."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]] if len(rows) >= k else rows[rng.integers(0, len(rows), k)]
    for _ in range(rounds):
        own = nearest(rows, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=rows[:, d], minlength=k) for d in range(rows.shape[1])], 1)
        fresh = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty) and len(rows) > k:
            fresh[empty] = rows[np.argsort(-((rows - centres[own]) ** 2).sum(1), kind="stable")[: len(empty)]]
        if np.allclose(fresh, centres, atol=1e-7):
            break
        centres = fresh
    return centres


def fit(vectors: DataFrame, cells: int | None = None, pieces: int | None = None, sample: int = SAMPLE) -> Model | None:
    """A model from at most twice ``sample`` rows of ``vectors`` (embedding), chosen by a hash of the vector, so reruns agree.

    ``cells``: about the square root of the number of rows, at most MOST_CELLS, unless given. ``pieces``: bytes of a code; half the length of a vector
    unless given. None if no vector has a direction. Vectors have the length that most of the sample have.
    """
    n = vectors.count()
    chosen = vectors.where("embedding is not null").where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) <= F.lit(int((1 << 20) * min(1.0, sample / max(1, n)))))
    rows = sorted((list(map(float, r[0])) for r in chosen.select("embedding").distinct().limit(2 * sample).collect() if None not in r[0]), key=lambda v: (len(v), v))
    lengths = [len(v) for v in rows if v]
    if not lengths:
        return None
    dim = max(sorted(set(lengths)), key=lengths.count)
    model = Model(np.zeros((1, dim)), np.zeros((1, 1, dim)))
    units = model.unit(rows)
    units = units[units.any(1)]
    if not len(units):
        return None
    wanted = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    model.centroids = k_means(units, wanted)
    pieces = next(p for p in range(pieces or max(1, dim // 2), 0, -1) if dim % p == 0)
    rest, width = units - model.centroids[model.cell(units)], dim // pieces
    model.books = np.stack([k_means(rest[:, p * width : (p + 1) * width], BOOK, seed=p + 1) for p in range(pieces)])
    return model


def _kept(spark: SparkSession, model: Model, path: str) -> None:
    rows = [("centroid", i, 0, [float(x) for x in c]) for i, c in enumerate(model.centroids)]
    rows += [("book", p, i, [float(x) for x in c]) for p, book in enumerate(model.books) for i, c in enumerate(book)]
    spark.createDataFrame(rows, "kind string, a int, b int, at array<double>").coalesce(1).write.parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    """The model: at most MOST_CELLS centroids and BOOK entries for each piece."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "a", "b").collect()
    centroids = np.array([r["at"] for r in rows if r["kind"] == "centroid"])
    books = [r["at"] for r in rows if r["kind"] == "book"]
    return Model(centroids, np.array(books).reshape(-1, BOOK, len(books[0])))


PLACED = "rep bigint, embedding array<float>, cell int, code binary, far double"
BLOCKS = "cell int, ids array<bigint>, codes binary, far array<double>"


def build(vectors: DataFrame, path: str, cells: int | None = None, pieces: int | None = None, sample: int = SAMPLE) -> Model | None:
    """Writes the index of ``vectors`` (vec_id, embedding) under ``path``: model, rows (rep, vec_id), full (cell, rep, embedding), codes (cell and packed blocks).

    Null and odd vectors are indexed in a cell of their own, with score 0. Rows of one vec_id are rows of their own.
    No vector with a direction: nothing is written and the result is None.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(F.col("embedding").cast("array<float>"), F.array().cast("array<float>")).alias("embedding"))
    model = fit(rows, cells, pieces, sample)
    if model is None:
        return None
    _kept(spark, model, path)
    # equal vectors are merged before they move; rep is the number of a distinct vector
    distinct, made = write_table(rows.groupBy("embedding").agg(F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    rows.join(distinct, "embedding").select("rep", "vec_id").write.parquet(f"{path}/rows")
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            units = model.unit(batch.column(1).to_pylist())
            cell = model.cell(units)
            codes, far = model.encode(units, cell)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far)], names=["rep", "embedding", "cell", "code", "far"])

    placed, temporary = write_table(distinct.select("rep", "embedding").mapInArrow(place, PLACED), "placed-vectors")
    # ranges of (cell, rep): a cell is in few files, a large one in several
    ordered = placed.repartitionByRange(shuffle_partitions(spark), "cell", "rep").sortWithinPartitions("cell", "rep")
    ordered.select("rep", "embedding", "cell").write.partitionBy("cell").parquet(f"{path}/full")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, far = pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([[h[3] for h in held]], pa.list_(pa.float64()))
            codes = pa.array([b"".join(h[2] for h in held)], pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), ids, codes, far], names=["cell", "ids", "codes", "far"])
            held.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held and (held[0][0] != row[0] or len(held) == PACKED):
                    yield out()
                held.append(row)
        if held:
            yield out()

    ordered.select("cell", "rep", "code", "far").mapInArrow(pack, BLOCKS).write.partitionBy("cell").parquet(f"{path}/codes")
    for done in (made, temporary):
        drop_table(spark, done)
    return model


def _asked(shared, probes: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cell, query_id, unit: the cells that each query looks at; NOWHERE always."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = len(model.centroids)
        for batch in batches:
            for ids, vectors in ((batch.column(0).slice(i, 256).to_pylist(), batch.column(1).slice(i, 256).to_pylist()) for i in range(0, batch.num_rows, 256)):
                units = model.unit(vectors)
                near = np.argsort(-(units @ model.centroids.T), axis=1, kind="stable")[:, : probes or n]
                cells = np.concatenate([np.full((len(ids), 1), NOWHERE), near], 1)
                width = cells.shape[1]
                each = pa.array([u for x in units.tolist() for u in [x] * width], pa.list_(pa.float64()))
                numbers = pa.array(np.repeat(np.array(ids, object), width), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), numbers, each], names=["cell", "query_id", "unit"])

    return run


def _compared(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query_id, rep, cell, low, high: of a block of codes and a block of queries what may be among the ``k`` best of that block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen: dict[int, float] = {}  # the best k-th lower bound of a query in this task
        for batch in batches:
            for i in range(batch.num_rows):
                cell, ids, codes, far, asked = (batch.column(c)[i].as_py() for c in range(5))
                units, ids = np.array([q["unit"] for q in asked]), np.array(ids)
                if cell == NOWHERE:
                    middle = np.zeros((len(units), len(ids)))
                    far = np.zeros(len(ids))
                else:
                    middle = model.scores(units, cell, np.frombuffer(codes, np.uint8).reshape(len(ids), -1))
                # a query without a direction scores 0 with all, whatever the codes say
                wide = np.where(units.any(1)[:, None], np.array(far)[None, :] + SLACK, 0)
                low, high = middle - wide, middle + wide
                least = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(units), -np.inf)
                least = np.maximum(least, [seen.get(x["query_id"], -np.inf) for x in asked])
                seen.update(zip((x["query_id"] for x in asked), least.tolist(), strict=True))
                q, v = np.nonzero(high >= least[:, None])
                numbers = pa.array([asked[x]["query_id"] for x in q], pa.int64())
                cells = pa.array(np.full(len(v), cell), pa.int32())
                yield pa.RecordBatch.from_arrays([numbers, pa.array(ids[v]), cells, pa.array(low[q, v]), pa.array(high[q, v])], names=["query_id", "rep", "cell", "low", "high"])

    return run


def candidates(queries: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """query_id, rep, cell of the distinct vectors that may be among the ``k`` best of each query (query_id, q)."""
    spark = queries.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load(spark, path))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("q").cast("array<double>").alias("q")).mapInArrow(_asked(shared, probes), "cell int, query_id bigint, unit array<double>")
    groups = -(-queries.count() // QUERIES) or 1
    blocks = asked.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("query_id", "unit")).alias("asked"))
    # cells that no query looks at are not read; at most MOST_CELLS numbers
    wanted = None if probes is None else [r[0] for r in asked.select("cell").distinct().collect()]
    codes = spark.read.schema(BLOCKS).parquet(f"{path}/codes")
    codes = codes if wanted is None else codes.where(F.col("cell").isin(wanted))
    met = codes.join(blocks, "cell").select("cell", "ids", "codes", "far", "asked").mapInArrow(_compared(shared, k), "query_id bigint, rep bigint, cell int, low double, high double")
    found, _ = write_table(met, "candidates")
    # the k best by their lower bounds are scored in full: the k-th of their scores, less what sums may be off, is a far better
    # bound than theirs; Spark keeps only k rows a task and query for them
    order = Window.partitionBy("query_id").orderBy(F.col("low").desc(), "rep")
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("query_id", "rep", "cell", "low", "high")
    exact = _full(spark, path).join(best, ["cell", "rep"]).join(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "q"), "query_id")
    exact = exact.select("query_id", F.greatest("low", F.least("high", vx.cosine(F.col("embedding"), F.col("q")) - SLACK)).alias("low"))
    least, _ = write_table(exact.groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("n")), "bounds")
    return found.join(least, "query_id").where((F.col("high") >= F.col("least")) | (F.col("n") < k)).select("query_id", "rep", "cell")


def _full(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rep bigint, embedding array<float>, cell int").parquet(f"{path}/full")


def search(queries: DataFrame, path: str, k: int = 5, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` most similar rows of each query (query_id, q), ties by vec_id (null last).

    ``probes``: how many cells each query looks at; None: all, and the result is that of ``search.batched``. query_id tells
    queries apart. An index without rows is not there and can't be searched.
    """
    spark = queries.sparkSession
    chosen = candidates(queries, path, k, probes)
    exact = _full(spark, path).join(chosen, ["cell", "rep"]).join(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "q"), "query_id").select("query_id", "rep", vx.cosine(F.col("embedding"), F.col("q")).alias("score"))
    # k scores at most stand for a query's best rows; vectors of equal score all stay, as their rows compete by vec_id
    ranked = exact.withColumn("at", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("at") <= k).drop("at")
    rows = spark.read.schema("rep bigint, vec_id bigint").parquet(f"{path}/rows").join(ranked.select("rep").distinct(), "rep", "left_semi")
    own = rows.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("at") <= k).select("rep", "vec_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return ranked.join(own, "rep").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def shares(queries: DataFrame, path: str, k: int = 5, probes: int | None = None) -> DataFrame:
    """One row: scanned (share of the codes that a query looks at, on average) and reread (share of the vectors read in full)."""
    spark = queries.sparkSession
    chosen = candidates(queries, path, k, probes).groupBy().agg(F.count("*").alias("c"))
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/codes").groupBy("cell").agg(F.sum(F.size("ids")).alias("n"))
    shared = spark.sparkContext.broadcast(load(spark, path))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("q").cast("array<double>").alias("q")).mapInArrow(_asked(shared, probes), "cell int, query_id bigint, unit array<double>")
    looked = asked.join(sizes, "cell").agg(F.sum("n").alias("looked"), F.countDistinct("query_id").alias("queries"))
    one = looked.crossJoin(chosen).crossJoin(sizes.agg(F.sum("n").alias("all")))  # one row each
    return one.select((F.col("looked") / F.col("queries") / F.col("all")).alias("scanned"), (F.col("c") / F.col("queries") / F.col("all")).alias("reread"))
