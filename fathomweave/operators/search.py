"""Weighted vector search over nodes, single and in batches, and the sub-graph around the best hit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomweave.functions import lexicon as lx
from fathomweave.functions import text as tx
from fathomweave.functions import vectors as vx
from fathomweave.operators import graph
from fathomweave.runtime import shuffle_partitions, ship


@dataclass
class SearchQuery:
    vector: list[float]
    entity_types: list[str] | None = None
    max_results: int = 10
    similarity_threshold: float = 0.3
    cut: float = 0.1
    weights: dict[str, float] = field(default_factory=lambda: dict(lx.SEARCH_WEIGHTS))
    #: A vector of its own for some of title, parent and desc; ``vector`` for the others.
    own: dict[str, list[float]] = field(default_factory=dict)


#: Vectors and queries of a block, queries that a task meets, pairs whose scores are summed at once.
VECTORS, BLOCK, TOGETHER, PAIRS = 2048, 1024, 1 << 14, 1 << 18
#: Of the products of blocks, in double.
SLACK = 1e-9
PROCEDURES = {"entity_types": ["Procedure"], "similarity_threshold": 0.2, "max_results": 10}
BY_DESCRIPTION = {"entity_types": ["Procedure"], "similarity_threshold": 0.3, "max_results": 10}
AUTHENTICATION = {"entity_types": ["Procedure"], "similarity_threshold": 0.2, "max_results": 20}
AUTHENTICATION_TEXT = "authentication process between UE and 5G core network"


def index(nodes: DataFrame, strict: bool = False) -> DataFrame:
    """The last node of each name (``strict``: of each name and type)."""
    return graph.last_wins(nodes, ["name", "entity_type"] if strict else ["name"])


def scored(nodes: DataFrame, query: SearchQuery) -> DataFrame:
    """Adds title_score, parent_score, desc_score and final_score; a missing vector scores 0."""
    rows = nodes.withColumns({f"{k}_score": vx.cosine(F.col(c), vx.literal_vector(query.own.get(k, query.vector))) for k, c in (("title", "title_embedding"), ("parent", "parent_embedding"), ("desc", "embedding"))})
    w = query.weights
    return rows.withColumn("final_score", F.lit(w["title"]) * F.col("title_score") + F.lit(w["parent"]) * F.col("parent_score") + F.lit(w["description"]) * F.col("desc_score"))


def search(nodes: DataFrame, query: SearchQuery) -> DataFrame:
    """Filters first, then the best ``max_results`` by score, ties in load order (seq)."""
    rows = scored(nodes, query).where((F.col("final_score") > query.cut) & (F.col("final_score") >= query.similarity_threshold))
    if query.entity_types:
        rows = rows.where(F.col("entity_type").isin(query.entity_types))
    return rows.orderBy(F.col("final_score").desc(), "seq").limit(query.max_results)


def search_procedures(nodes: DataFrame, vector: list[float], max_results: int = 10) -> DataFrame:
    """(name, score, description, properties) of the best procedures."""
    found = search(nodes, SearchQuery(vector, **{**PROCEDURES, "max_results": max_results}))
    return found.select("name", F.col("final_score").alias("score"), "description", "properties")


def by_description(nodes: DataFrame, vector: list[float]) -> DataFrame:
    return search(nodes, SearchQuery(vector, **BY_DESCRIPTION))


def authentication_procedures(nodes: DataFrame, encode: Callable[[str], list[float]]) -> DataFrame:
    """The procedures nearest to a fixed text; ``encode`` gives its vector."""
    return search(nodes, SearchQuery(encode(AUTHENTICATION_TEXT), **AUTHENTICATION))


def all_entities(nodes: DataFrame) -> DataFrame:
    """The whole index, one row a name."""
    return index(nodes)


def procedure_details(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, description, steps, relationships, properties) of each of ``names`` (name) that is a procedure.

    steps: (name, description) of its Step nodes in natural order; three stand-ins where it has none. relationships: the edges that touch it.
    """
    own = index(nodes).where("entity_type = 'Procedure'").join(names.select("name").distinct(), "name", "left_semi")
    made = nodes.where("entity_type = 'Step'").select(F.col("properties")["procedure"].alias("name"), F.struct(tx.natural_key("name").alias("k"), F.col("name").alias("step"), "description").alias("s"))
    made = made.join(own.select("name"), "name", "left_semi").groupBy("name").agg(F.array_sort(F.collect_list("s")).alias("found"))
    near = edges.select(F.explode(F.array_distinct(F.array("source_name", "target_name"))).alias("name"), F.struct("source_name", "rel_type", "target_name").alias("e"))
    near = near.join(own.select("name"), "name", "left_semi").groupBy("name").agg(F.array_sort(F.collect_list("e")).alias("relationships"))
    plain = F.regexp_replace("name", "[ /-]", "_")
    stand_in = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.concat(plain, F.lit("_step_"), i).alias("name"), F.concat(F.lit("Execute step "), i, F.lit(" of "), F.col("name")).alias("description")))
    real = F.transform("found", lambda x: F.struct(x["step"].alias("name"), x["description"].alias("description")))
    joined = own.join(made, "name", "left").join(near, "name", "left")
    return joined.select("name", F.coalesce("description", F.concat(F.lit("3GPP procedure: "), F.col("name"))).alias("description"), F.coalesce(real, stand_in).alias("steps"), "relationships", "properties")


def demonstration(nodes: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score, drawn): the ``k`` best of each query (query_id, q); the machine of the first is to be drawn."""
    return batched(nodes, queries, k).withColumn("drawn", F.col("rank") == 1)


def _packed(most: int, copies: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """dim, ids, raw: rows (id, vector) in blocks of at most ``most`` vectors of one length, as doubles; dim -1: null or with nulls.

    ``copies``: of equal vectors of a block the rows of so many smallest ids; the others can't be among as many best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[int]] = {}
            vectors = batch.column(1).to_pylist()
            for i, v in enumerate(vectors):
                by.setdefault(-1 if v is None or None in v else len(v), []).append(i)
            ids = batch.column(0).to_pylist()
            for dim, own in by.items():
                for lo in range(0, len(own), most):
                    block = own[lo : lo + most]
                    if copies is not None:
                        met: dict[bytes, int] = {}
                        block.sort(key=lambda i: (ids[i] is None, ids[i] or 0))
                        block = [i for i in block if met.setdefault(x := b"" if dim < 0 else np.array(vectors[i], "<f8").tobytes(), 0) < copies and not met.update({x: met[x] + 1})]
                    raw = b"" if dim < 0 else np.array([vectors[i] for i in block], "<f8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([[ids[i] for i in block]], pa.list_(pa.int64())), pa.array([raw], pa.binary())], names=["dim", "ids", "raw"])

    return run


def _norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * x[:, d]
    return np.sqrt(total)


def _best(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query_id, vec_id, score: the ``k`` best of each query among the blocks of vectors it meets in this task.

    Products of whole blocks rule out what is worse than the k best so far by more than they can be off; the scores of the rest are
    summed in the order of ``vectors.cosine``, so they are its scores to the last bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # of each block of queries: ids, vectors, norms, units and the best so far
        unpacked: tuple = (None, None)

        def matrix(dim: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.frombuffer(raw, "<f8").reshape(-1, dim)
            n = _norms(x)
            fine = np.isfinite(n) & (n > 0)
            return x, n, np.where(fine[:, None], x / np.where(fine, n, 1)[:, None], 0)

        def compare(v: tuple, asked: list) -> None:
            (dim, ids, null, x), (qdim, q, best) = v, asked
            alike = dim == qdim and dim > 0
            if alike:
                (vectors, vn, vu), (queries, qn, qu) = x, q
                tiny = min(vn[vn > 0].min(initial=1), 1) * min(qn[qn > 0].min(initial=1), 1) < 1e-290
                near = qu @ vu.T
            else:
                near, tiny = np.zeros((len(best[0]), len(ids))), False
            least = best[0][:, -1]
            if len(ids) > k and np.isinf(least).any():
                least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
            at, of = np.nonzero(near >= (-np.inf if tiny else least[:, None] - SLACK))
            if not len(at):
                return
            score = np.zeros(len(at))
            if alike:
                for lo in range(0, len(at), PAIRS):
                    i, j = at[lo : lo + PAIRS], of[lo : lo + PAIRS]
                    total = np.zeros(len(i))
                    for d in range(dim):
                        total += vectors[j, d] * queries[i, d]
                    under = vn[j] * qn[i]
                    value = total / np.where(under == 0, 1, under)
                    score[lo : lo + PAIRS] = np.where((under == 0) | np.isnan(value), 0, value)
            hit = np.unique(at)
            at = np.concatenate([np.repeat(hit, k), at])
            score = np.concatenate([best[0][hit].ravel(), score])
            empty, number = np.concatenate([best[1][hit].ravel(), null[of]]), np.concatenate([best[2][hit].ravel(), ids[of]])
            order = np.lexsort((number, empty, -score, at))
            place = np.arange(len(order)) - np.repeat(np.flatnonzero(np.diff(at[order], prepend=-1)), np.bincount(at)[hit])
            kept = order[place < k]
            for part, values in zip(best, (score, empty, number), strict=True):
                part[hit] = values[kept].reshape(-1, k)

        with np.errstate(all="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    dim, ids, raw, qdim, qids, qraw = (batch.column(c)[i] for c in range(6))
                    whole = raw.as_buffer().to_pybytes()
                    if unpacked[0] != (ids, whole):
                        numbers = pc.fill_null(ids.values, (1 << 63) - 1).to_numpy()
                        unpacked = ((ids, whole), (dim.as_py(), numbers, pc.is_null(ids.values).to_numpy(zero_copy_only=False), matrix(dim.as_py(), whole) if dim.as_py() > 0 else None))
                    asked = qraw.as_buffer().to_pybytes()
                    key = (tuple(qids.as_py()), asked)
                    if key not in held:
                        n = len(key[0])
                        held[key] = [qdim.as_py(), matrix(qdim.as_py(), asked) if qdim.as_py() > 0 else None, [np.full((n, k), -np.inf), np.ones((n, k), bool), np.zeros((n, k), np.int64)]]
                    compare(unpacked[1], held[key])
        for (qids, _), (_, _, (score, null, number)) in held.items():
            i, j = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in i], pa.int64()), pa.array(number[i, j], mask=null[i, j]), pa.array(score[i, j])], names=["query_id", "vec_id", "score"])

    return run


def batched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` most similar rows of each query (query_id, q), ties by vec_id (null last); ids are whole numbers.

    Blocks of vectors meet blocks of queries, part by part, so nothing that grows with them is broadcast; of each part of the rows
    only the best of a query are shuffled. ``vector_index`` gives the same rows and reads less.
    """
    spark = vectors.sparkSession
    ship(spark)
    packed = "dim int, ids array<bigint>, raw binary"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_packed(VECTORS, k), packed)
    asked = queries.select(F.col("query_id").cast("bigint").alias("id"), F.col("q").cast("array<double>").alias("v")).mapInArrow(_packed(BLOCK), "qdim int, qids array<bigint>, qraw binary")
    parts = -(-queries.count() // TOGETHER) or 1
    pairs = rows.repartition(shuffle_partitions(spark)).crossJoin(asked.repartition(parts).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(_best(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(items: DataFrame, vector: list[float]) -> DataFrame:
    """The one item most similar to a vector."""
    return items.withColumn("similarity", vx.cosine(F.col("embedding"), vx.literal_vector(vector))).orderBy(F.col("similarity").desc(), "item").limit(1)


def focused(items: DataFrame, mentions: DataFrame, vector: list[float], k: int = 5) -> DataFrame:
    """(rank, item, similarity): the ``k`` items most similar to the best hit among those that share an entity with it.

    Items: item, embedding; mentions: item, entity. No row if none shares one.
    """
    start = nearest(items, vector)
    related = graph.siblings(mentions, start).join(items, "item")
    one = start.select(F.col("embedding").alias("s"))  # one row
    rows = related.crossJoin(F.broadcast(one)).select("item", vx.cosine(F.col("embedding"), F.col("s")).alias("similarity"))
    best = rows.orderBy(F.col("similarity").desc(), "item").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "item")))
