"""Near-duplicate documents at a given similarity of word shingles, found by SimHash and covering masks.

Two texts that share 80 % of their shingles differ in about ten of 64 plain SimHash bits, too many for any
covering family. Here each text has several fingerprints in which a shingle's vote is weighted by a draw
from a heavy tail (u to the power -3, u from the shingle's own hash, so the same everywhere): a fingerprint then
hangs on a text's few heaviest shingles, and texts at a similarity of 0.8 agree on one up to one bit with a chance
of 0.74. With eight of them such a pair is missed with a chance of about 0.00002. The covering masks for radius 1
bring all others together, as in operator 1.

Texts that meet are compared exactly (Jaccard of their shingle sets), in two rounds that make no pairs within
groups. First each text of a group meets the group's hub, its smallest node; what is linked is one component from
then on. Then, in each group that still holds texts of several components, all texts of different components are
held against each other by size and by odd sketch (which bits of a table are hit an odd number of times; two
sketches differ in at most as many bits as the sets differ in shingles, so no pair at 0.8 is ruled out), and those
left are compared exactly. Groups over VOLUME shingles are dealt into blocks, and each block meets itself and each other: a
passage that many texts share, or a large group of edited copies, costs no more memory than two blocks.
Copies are folded into one text before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomweave.llm.components import connected_components
from fathomweave.llm.simhash import covering_masks
from fathomweave.runtime import drop_table, let_go, ship, write_table

PRINTS, HEAVIEST, RADIUS, TAIL = 8, 32, 1, 3.0
#: Shingles in a block of a crowd: VOLUME, or a sixteenth of a crowd that is larger, up to LARGEST.
VOLUME, LARGEST = 1 << 18, 1 << 22
BLOCK = 1 << 16
#: Bits of an odd sketch: the next power of two, within these.
SKETCH_BITS = (6, 16)
SEED = 42


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of a text, A-Z in lower case; texts of fewer words are one shingle, without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, max(1, len(words) - size + 1)))


def _mixed(h: np.ndarray, ks: range) -> np.ndarray:
    """A row of 64-bit hashes of ``h`` (its last axis) for each of ``ks``."""
    with np.errstate(over="ignore"):
        x = h + (np.array(ks, np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def weighted_prints(h: np.ndarray) -> list[int]:
    """PRINTS fingerprints of a shingle set as signed 64-bit numbers; only the HEAVIEST shingles of each have a vote."""
    draw = _mixed(h, range(PRINTS))
    if draw.shape[1] > HEAVIEST:
        draw = np.partition(draw, HEAVIEST - 1, axis=1)[:, :HEAVIEST]
    draw = np.sort(draw, axis=1)
    weight = ((draw.astype(np.float64) + 1) / 2.0**64) ** -TAIL
    signs = np.unpackbits(_mixed(draw, range(PRINTS, 2 * PRINTS)).view(np.uint8).reshape(PRINTS, -1, 8), axis=2, bitorder="little")
    # both rows of a print use the same draws, so row k of the second mix goes with row k of the first
    bits = np.einsum("kn,knb->kb", weight, 2.0 * signs - 1) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def odd_sketch(h: np.ndarray) -> bytes:
    """The bits that an odd number of shingles falls on; half of a longer sketch laid over the other is the shorter one."""
    bits = 1 << min(max((max(len(h), 1) - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def most_apart(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """In how many shingles sets of these sizes can differ at that Jaccard similarity."""
    return (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """o (doc_id, null last, and two hashes that tell rows apart), node (key of the shingle set), n (its size), prints, odd, ids (the shingles' low 32 bits, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        let_go()
        for batch in batches:
            node, n, prints, odd, ids = [], [], [], [], []
            for cell in batch.column(1):
                h = shingles(cell.as_py(), shingle)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63))
                n.append(len(h))
                prints.append(weighted_prints(h) if len(h) else [])
                odd.append(odd_sketch(h))
                ids.append(np.unique((h & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(odd, pa.binary()), pa.array(ids, pa.binary())], names=["o", "node", "n", "prints", "odd", "ids"])

    ship(docs.sparkSession)
    rows = docs.select(F.struct(*_row_key(docs)).alias("o"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "o struct<d:bigint,h:bigint,g:bigint>, node bigint, n bigint, prints array<bigint>, odd binary, ids binary")


def _row_key(docs: DataFrame) -> list[Column]:
    """doc_id (null: the largest number) and two hashes of doc_id and text."""
    doc_id, text = docs["doc_id"].cast("bigint"), docs["text"].cast("string")
    return [F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(doc_id.isNull(), doc_id, text).alias("h"), F.xxhash64(F.lit(1), doc_id, text).alias("g")]


def _keys() -> Column:
    """What each print shows under each covering mask, as one hash."""
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(RADIUS)]
    return F.flatten(F.transform("prints", lambda p, k: F.array(*[F.xxhash64(k, F.lit(t), p.bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])))


def _can(similarity: float):
    """Keeps the pairs (a, b, n, odd, m, even) that sizes and odd sketches allow."""

    def folded(x: np.ndarray, words: int) -> np.ndarray:
        return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            can = np.minimum(n, m) >= similarity * np.maximum(n, m)
            most = most_apart(n, m, similarity)
            for i in np.flatnonzero(can):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (3, 5))
                words = min(len(x), len(y))
                can[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum() <= most[i]
            yield batch.filter(pa.array(can, pa.bool_())).select(["a", "b"])

    return run


def _alike(similarity: float):
    """Keeps the pairs (a, b, x, y) whose sets of ids have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _with_ends(pairs: DataFrame, nodes: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``pairs`` (a, b) with columns of ``nodes`` for either end; columns: name in nodes -> names for a and b."""
    left = pairs.join(nodes.select(F.col("node").alias("b"), *[F.col(c).alias(y) for c, (_, y) in columns.items()]), "b")
    return left.join(nodes.select(F.col("node").alias("a"), *[F.col(c).alias(x) for c, (x, _) in columns.items()]), "a")


def survivors(n: np.ndarray, group: np.ndarray, block: np.ndarray, sketches: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of these texts can be that similar to one of another group (and another block, if there are two)."""
    found, words = np.zeros(len(n), bool), np.array([len(x) for x in sketches])
    two = bool((block != block[0]).any())
    for w in np.unique(words):
        own, longer = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        every = np.concatenate([own, longer])
        if len(every) < 2:
            continue
        table = np.stack([sketches[i] if len(sketches[i]) == w else sketches[i][:w] ^ sketches[i][w:] for i in every])
        step = max(1, (1 << 20) // (len(every) * int(w)))
        for at in range(0, len(own), step):
            mine = own[at : at + step]
            can = (group[mine][:, None] != group[every]) & (np.minimum(n[mine][:, None], n[every]) >= similarity * np.maximum(n[mine][:, None], n[every]))
            if two:
                can &= block[mine][:, None] != block[every]
            if not can.any():
                continue
            apart = np.bitwise_count(table[at : at + len(mine), None] ^ table).sum(axis=2, dtype=np.int64)
            can &= apart <= most_apart(n[mine][:, None], n[every], similarity)
            found[mine] |= can.any(axis=1)
            found[every] |= can.any(axis=0)
    return found


def cell_links(sets: list[np.ndarray], similarity: float, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (places in ``sets``, of distinct numbers) of at least that similarity, which connect all that such pairs connect; those of one ``group`` are connected already."""
    size = np.array([len(x) for x in sets], np.int64)
    _, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[flat] > 1  # the others are in no intersection
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(sets)), size)[shared], minlength=len(sets)))
    flat, starts = flat[shared].astype(np.int32), np.concatenate([[0], ends[:-1]])
    mark, found = np.zeros(len(count), np.int32), []
    group = np.arange(len(sets)) if group is None else group.copy()
    for i in range(len(sets) - 1):
        rest = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i])))
        if not len(rest):
            continue
        own = flat[starts[i] : ends[i]]
        mark[own] = 1
        if len(rest) <= 32:
            both = np.array([mark[flat[starts[j] : ends[j]]].sum() for j in rest])
        else:
            sums = np.concatenate([[0], np.cumsum(mark[flat[ends[i] :]])])
            both = sums[ends[rest] - ends[i]] - sums[starts[rest] - ends[i]]
        mark[own] = 0
        for j in rest[both >= similarity * (size[i] + size[rest] - both)]:
            if group[j] != group[i]:
                found.append((i, int(j)))
                group[group == group[j]] = group[i]
    return found


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (key, i, j), from batches in which they stand together."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1)
        cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), len(cells)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = tuple(cells[lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _crowd_links(crowds: DataFrame, nodes: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """(a, b) and where they are written: pairs within the groups of ``crowds`` (key, node, component) that connect all of that similarity and of different components."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for cell in _by_cell(batches):
            n, group, block = (cell.column(c).to_numpy() for c in ("n", "component", "own"))
            kept = survivors(n, group, block, [np.frombuffer(x.as_buffer(), "<u8") for x in cell.column("odd")], similarity)
            if kept.any():
                yield from cell.filter(pa.array(kept)).select(["key", "i", "j", "node", "component"]).to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for cell in _by_cell(batches):
            node, ids = cell.column("node").to_pylist(), [np.frombuffer(x.as_buffer(), "<u4") for x in cell.column("ids")]
            found = cell_links(ids, similarity, np.unique(cell.column("component").to_numpy(), return_inverse=True)[1])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], names=["a", "b"])

    spark, cell = crowds.sparkSession, ["key", "i", "j"]
    sized = crowds.join(nodes.select("node", "n"), "node")
    one = sized.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.sum("n").alias("all")).where("lo <> hi")
    # masks and prints that show the same texts make one group
    blocks = F.ceil(F.col("all") / F.least(F.greatest(F.lit(VOLUME), F.col("all") / 16), F.greatest(F.lit(VOLUME), F.lit(LARGEST)))).cast("int")
    one = one.groupBy("size", "x", "y").agg(F.min(F.struct("key", blocks.alias("blocks"))).alias("g")).select("g.key", "g.blocks")
    dealt = crowds.join(one, "key").withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    # a cell for each two blocks, in which those of different blocks are compared, and one for each block itself
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    cells = dealt.select("key", "node", "component", "own", other.alias("k")).select("key", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "node", "component")
    rows = cells.join(nodes.select("node", "n", "odd"), "node").select(*cell, "own", "node", "component", "n", "odd")
    left, path = write_table(rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(possible, "key bigint, i int, j int, node bigint, component bigint"), "possible")
    rows = left.join(nodes.select("node", "ids"), "node").select(*cell, "node", "component", "ids")
    links, links_path = write_table(rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(linked, "a bigint, b bigint"), "near-links")
    drop_table(spark, path)
    return links, links_path


def near_components(nodes: DataFrame, similarity: float) -> tuple[DataFrame, list[str]]:
    """(node, component) of all ``nodes`` (node, n, prints, odd, ids) with a link, and the tables to drop when it was read.

    Linked are pairs of at least that similarity that share a masked print.
    """
    spark, paths = nodes.sparkSession, []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        table, path = write_table(df, tag)
        paths.append(path)
        return table

    members = nodes.where("n > 0").select("node", F.explode(_keys()).alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("hi"), F.count("*").alias("size")).where("hub <> hi").select("key", "hub", "size")
    groups = kept(members.join(shared, "key").where("node <> hub").select("key", "node", "hub", "size"), "groups")
    star = _with_ends(groups.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes, {"n": ("n", "m"), "odd": ("odd", "even")})
    star = kept(star.select("a", "b", "n", "odd", "m", "even").mapInArrow(_can(similarity), "a bigint, b bigint"), "star")
    ends = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = kept(nodes.select("node", "ids").join(ends, "node", "left_semi"), "sets")
    links = kept(_with_ends(star, sets, {"ids": ("x", "y")}).select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a bigint, b bigint"), "near-links")
    drop_table(spark, paths.pop(-2))
    first = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), paths)
    # with the hub everything was compared already
    crowds = groups.where("size > 2").select("key", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    crowds = kept(crowds.select("key", "node", "component"), "crowds")
    more, path = _crowd_links(crowds, nodes, similarity)
    paths.append(path)
    last: list[str] = []
    whole = connected_components(links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v")), last)
    for path in paths:
        drop_table(spark, path)
    return whole, last


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without near copies, with the same columns.

    Of each group (rows connected by pairs of at least that similarity) the row with the smallest doc_id stays,
    null last; of rows alike in doc_id and text, the one whose other columns have the smallest hash. Null texts and
    texts without a word have no shingles: they are copies of one another and one of them stays. An empty table
    stays empty.
    """
    spark = docs.sparkSession
    folded = sketched(docs, shingle).groupBy("node").agg(F.min("o").alias("o"), *[F.first(c).alias(c) for c in ("n", "prints", "odd", "ids")])
    nodes, path = write_table(folded, "nodes")
    parts, paths = near_components(nodes, similarity)
    grouped = nodes.select("node", "o").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept, _ = write_table(grouped.groupBy("component").agg(F.min("o").alias("o")).select("o.*"), "kept")
    for done in (path, *paths):
        drop_table(spark, done)
    # the input's columns travel in one struct, so that no name can clash; repeated rows are folded before they are sent
    rest = [F.to_json(F.struct(docs[c])) if "map<" in kind else docs[c] for c, kind in docs.dtypes if c not in ("doc_id", "text")]
    rows = docs.select(*_row_key(docs), F.xxhash64(F.lit(2), *rest).alias("rest"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.groupBy("d", "h", "g").agg(F.min_by("row", "rest").alias("row"))
    return rows.join(kept, ["d", "h", "g"], "left_semi").select("row.*")
