"""Operator 11: conversation structure repair by A* on the edit lattice.

A node of the lattice is (rows done, state of the roles written: none, system, user, assistant); its edges are Keep,
Rerole, Delete and Insert. The heuristic is the suffix sum of what no repair can avoid: 4 for each row that must be
deleted, 3 for each truncated one. Nodes leave the queue by (cost plus heuristic, audit), so the first accepting one is
the cheapest with the least audit: no audit is the start of another one of the same cost and node, as only Inserts could follow.

Rows are sorted into ranges of (conversation, turn, role, text), so a conversation of any size is spread over tasks, and
cut into blocks of bounded size. A conversation within one block is repaired at once. For others each block yields its
cheapest path between every two states; paths of neighbouring blocks are joined by the same search, FAN blocks at a time,
until one is left, and its audit is dealt back to the blocks, which write their part of the repaired text. Only SHA-256,
which has no parallel form, passes over a conversation's parts in order, as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.llm import sqltext
from fathomweave.runtime import drop_table, ship, shuffle_partitions, write_table

#: Rows and characters in a block, and blocks joined at a time.
BLOCK_ROWS, BLOCK_CHARS, FAN = 512, 4 << 20, 64
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WRITTEN = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
ACCEPTING = (NONE, ASSISTANT)
REROLE, DELETE, INSERT, CHARGE = 3, 4, 3, 3
CLEAN, MUST_GO, TRUNCATED = range(3)
BLANKS = " \t\n\x0b\x0c\r"

Paths = dict[int, tuple[int, str]]

BLOCK = "conv_id bigint, part int, at bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, turns bigint, lo bigint, hi bigint"
SEGMENT = f"{BLOCK}, cost bigint, audit string, sha string, paths array<struct<src:int,dst:int,cost:bigint,audit:string>>, lines array<struct<role:string,text:string>>"
COUNTS = ["n", "blank", "duplicate", "truncated", "illegal"]


def search(rest: list[int], edges: Callable[[int, int], Iterable[tuple[int, str, int, int]]], entry: int, wanted: Callable[[int], bool] | None = None) -> Paths:
    """Cheapest (cost, audit) from ``entry`` to each state at the end of the lattice, or to the first ``wanted`` one alone.

    ``rest``: the heuristic for each column; ``edges`` (column, state): cost, letters, column and state after.
    """
    last, closed, found = len(rest) - 1, set(), {}
    queue = [(rest[0], "", 0, entry)]
    while queue:
        key, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = key - rest[i]
        if i == last:
            if wanted is None:
                found[state] = (cost, audit)
            elif wanted(state):
                return {state: (cost, audit)}
        for price, letters, j, after in edges(i, state):
            if (j, after) not in closed:
                heapq.heappush(queue, (cost + price + rest[j], audit + letters, j, after))
    return found


def suffix_sums(least: list[int]) -> list[int]:
    out = [0]
    for x in reversed(least):
        out.append(out[-1] + x)
    return out[::-1]


def repair(rows: list[tuple[int, str]], entry: int = NONE, wanted: Callable[[int], bool] | None = None) -> Paths:
    """:func:`search` over ``rows`` (kind, initial of the role)."""

    def edges(i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        for target in "ua":
            if (state, target) in NEXT:
                yield INSERT, "I", i, NEXT[state, target]
        if i == len(rows):
            return
        kind, initial = rows[i]
        yield DELETE, "D", i + 1, state
        if kind == MUST_GO:
            return
        charge = CHARGE if kind == TRUNCATED else 0
        if (state, initial) in NEXT:
            yield charge, "K", i + 1, NEXT[state, initial]
        for target in "ua":
            if target != initial and (state, target) in NEXT:
                yield charge + REROLE, "R", i + 1, NEXT[state, target]

    return search(suffix_sums([(0, DELETE, CHARGE)[kind] for kind, _ in rows]), edges, entry, wanted)


def joined(blocks: list[dict[int, Paths]], entry: int) -> Paths:
    """:func:`search` over blocks in order, each given as its paths by entry state."""

    def edges(i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        for after, (cost, audit) in (blocks[i].get(state, {}) if i < len(blocks) else {}).items():
            yield cost, audit, i + 1, after

    return search(suffix_sums([min(cost for to in b.values() for cost, _ in to.values()) for b in blocks]), edges, entry)


def written(lines: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """The repaired ``role:text`` lines that ``audit`` makes of ``lines``, beginning in ``state``."""
    rows = iter(lines)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else "a" if state == USER else "u"
        state = NEXT[state, initial]
        yield f"{role if letter == 'K' else WRITTEN[initial]}:{text}"


def kind_of(text: str) -> int:
    bare = text.rstrip(BLANKS)
    return MUST_GO if not bare else CLEAN if bare[-1] in ".!?" else TRUNCATED


class _Block:
    """Rows of one conversation, in order, with what is counted over them."""

    def __init__(self) -> None:
        self.rows, self.lines, self.chars = [], [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns, self.lo, self.hi = 0, None, None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        kind, initial = kind_of(text), role[:1]
        if kind == MUST_GO:
            self.counts["blank"] += 1
        elif again:
            kind = MUST_GO
            self.counts["duplicate"] += 1
        elif kind == TRUNCATED:
            self.counts["truncated"] += 1
        if self.rows and self.rows[-1][1] + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.counts["n"] += 1
        if turn is not None and turn != self.hi:
            self.turns, self.lo, self.hi = self.turns + 1, turn if self.lo is None else self.lo, turn
        self.rows.append((kind, initial))
        self.lines.append((role, "" if kind == MUST_GO else text))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def record(self, conv: int | None, part: int, at: int, alone: bool) -> dict:
        ends = {"head": self.rows[0][1] if self.rows else None, "tail": self.rows[-1][1] if self.rows else None}
        out = {"conv_id": conv, "part": part, "at": at, **self.counts, **ends, "turns": self.turns, "lo": self.lo, "hi": self.hi}
        if alone:
            ((_, (cost, audit)),) = repair(self.rows, wanted=lambda state: state in ACCEPTING).items()
            text = "\n".join(written(self.lines, audit, NONE))
            return out | {"cost": cost, "audit": audit, "sha": hashlib.sha256(text.encode()).hexdigest(), "paths": None, "lines": None}
        paths = [{"src": s, "dst": d, "cost": cost, "audit": audit} for s in range(4) for d, (cost, audit) in repair(self.rows, s).items()]
        return out | {"cost": None, "audit": None, "sha": None, "paths": paths, "lines": [{"role": r, "text": t} for r, t in self.lines]}


def _batches(records: Iterable[dict], schema: pa.Schema, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of up to ``rows`` records, or of few where they carry long texts."""
    held, chars = [], 0
    for r in records:
        held.append(r)
        chars += len(r.get("text") or "") + sum(len(x["text"]) for x in r.get("lines") or [])
        if len(held) == rows or chars >= BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _segments(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block, conv, part, at, runs, begun = _Block(), None, 0, 0, 0, False
        for batch in batches:
            for row in batch.to_pylist():
                if begun and row["conv_id"] != conv:
                    # the first and the last run may go on in another partition
                    yield block.record(conv, part, at, alone=runs > 0 and at == 0)
                    block, at, runs = _Block(), 0, runs + 1
                begun, conv, part = True, row["conv_id"], row["part"]
                for k in range(row["copies"]):
                    if block.full():
                        yield block.record(conv, part, at, alone=False)
                        block, at = _Block(), at + 1
                    block.add(row["turn"], row["role"], row["text"], row["again"] or k > 0)
        if begun:
            yield block.record(conv, part, at, alone=False)

    return lambda batches: _batches(records(batches), schema)


def _merged(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """One block of all blocks of a group."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        out = {"conv_id": rows[0]["conv_id"], "rank": rows[0]["rank"] // FAN, **{c: sum(r[c] for r in rows) for c in COUNTS}, "turns": 0, "head": None, "tail": None, "lo": None, "hi": None}
        paths = []
        for r in rows:
            if r["head"] is not None:
                out["illegal"] += out["tail"] is not None and out["tail"] + r["head"] not in LEGAL
                out["head"], out["tail"] = r["head"] if out["head"] is None else out["head"], r["tail"]
            if r["lo"] is not None:
                out["turns"] += r["turns"] - (r["lo"] == out["hi"])
                out["lo"], out["hi"] = r["lo"] if out["lo"] is None else out["lo"], r["hi"]
            by: dict[int, Paths] = {}
            for p in r["paths"]:
                by.setdefault(p["src"], {})[p["dst"]] = (p["cost"], p["audit"])
            paths.append(by)
        out["paths"] = [{"src": s, "dst": d, "cost": cost, "audit": audit} for s in range(4) for d, (cost, audit) in joined(paths, s).items()]
        return pa.Table.from_pylist([out], schema)

    return run


def _dealt(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The part of a conversation's audit that falls to each block, with the state before it."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                audit, at, out = row["audit"], 0, 0
                with_system = (len(audit) - audit.count("D")) % 2 == 1
                for k, block in enumerate(row["sizes"]):
                    end, left = at, block["n"]
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    if k == len(row["sizes"]) - 1:
                        end = len(audit)
                    state = NONE if out == 0 else SYSTEM if with_system and out == 1 else USER if (out - with_system) % 2 else ASSISTANT
                    yield {"conv_id": row["conv_id"], "rank": block["rank"], "state": state, "piece": audit[at:end]}
                    out, at = out + end - at - audit.count("D", at, end), end

    return lambda batches: _batches(records(batches), schema)


def _texts(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                made = list(written([(x["role"], x["text"]) for x in row["lines"]], row["piece"], row["state"]))
                yield {"conv_id": row["conv_id"], "rank": row["rank"], "text": "\n".join(made) if made else None}

    return lambda batches: _batches(records(batches), schema, 16)


def _hashes(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """SHA-256 over the parts of each conversation, which come in order."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, digest, begun, some = None, hashlib.sha256(), False, False
        for batch in batches:
            for row in batch.to_pylist():
                if begun and row["conv_id"] != conv:
                    yield {"conv_id": conv, "sha": digest.hexdigest()}
                    digest, some = hashlib.sha256(), False
                begun, conv = True, row["conv_id"]
                if row["text"] is not None:
                    digest.update((b"\n" if some else b"") + row["text"].encode())
                    some = True
        if begun:
            yield {"conv_id": conv, "sha": digest.hexdigest()}

    return lambda batches: _batches(records(batches), schema)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies for every row: what crc32 of ``conv_id:turn`` (nulls: one space) modulo 20 does to it.

    0: no copy is left (role and text null), 1: empty text, 2: without ``.!?``, 3: two copies, 4: role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said("text"), "[.!?]", "")).when(fate != 0, said("text"))
    role = F.when(fate == 4, "user").when(fate != 0, said("role"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("bigint")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"{k}_"])
    return out


def _renamed(df: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.withColumnRenamed(k, f"{k}_")
    return df


def repaired(rows: DataFrame) -> DataFrame:
    """The repair of each conversation of ``rows`` (conv_id, turn, role, text, copies; copies 0: the row only names its conversation).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows go by turn (nulls first),
    those of one turn by role and text, copies side by side. Null is a conversation like others. Equal rows are merged
    before anything is sorted; a conversation without rows gives zeros, an empty audit and the hash of an empty text.
    """
    spark = rows.sparkSession
    ship(spark)
    keys = {"k": F.xxhash64("conv_id", "role", "text"), "l": F.xxhash64(F.lit(1), "conv_id", "role", "text")}
    # a row said again at a later turn: only what occurs at two turns or more has to be looked up
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    often = rows.where("copies > 0").select(*[x.alias(k) for k, x in keys.items()], place.alias("place")).groupBy("k", "l").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("k", "l", "first")
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumns(keys)
    known = merged.join(often, ["k", "l"], "left").withColumn("again", F.coalesce((F.col("copies") > 0) & (place != F.col("first")), F.lit(False)))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    # the start of a text is enough to cut ranges by, and keeps the sample of keys small
    ranged = known.withColumn("begins", F.substring("text", 1, 64)).repartitionByRange(shuffle_partitions(spark), *order, F.col("begins").asc_nulls_first())
    sorted_ = ranged.sortWithinPartitions(*order, F.col("begins").asc_nulls_first(), F.col("text").asc_nulls_first())
    segments = sorted_.select("conv_id", "turn", "role", "text", "copies", "again", F.spark_partition_id().alias("part")).mapInArrow(_segments(_arrow(SEGMENT)), SEGMENT)
    table, _ = write_table(segments, "conversation-blocks")
    alone = table.where("paths is null")
    whole = _spanning(table.where("paths is not null"))
    columns = ["conv_id", *COUNTS, "turns", "lo", "hi", "cost", "audit", "sha"]
    gaps = F.when(F.col("turns") > 0, F.col("hi") - F.col("lo") + 1 - F.col("turns")).otherwise(0).cast("bigint").alias("gaps")
    done = alone.select(*columns).unionByName(whole.select(*columns))
    return done.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def _spanning(table: DataFrame) -> DataFrame:
    """Conversations that may lie in several blocks, one row each."""
    spark = table.sparkSession
    ranked = table.withColumn("rank", (F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "at")) - 1).cast("bigint"))
    blocks, _ = write_table(ranked.drop("part", "at", "cost", "audit", "sha"), "conversation-ranks")
    ddl = "conv_id bigint, rank bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, turns bigint, lo bigint, hi bigint, paths array<struct<src:int,dst:int,cost:bigint,audit:string>>"
    schema = _arrow(ddl)
    level, before = blocks.select(*schema.names), None
    while (level.agg(F.max("rank")).first()[0] or 0) > 0:
        level, path = write_table(level.groupBy("conv_id", F.floor(F.col("rank") / FAN).alias("g")).applyInArrow(_merged(schema), ddl), "conversation-level")
        if before is not None:
            drop_table(spark, before)
        before = path
    best = F.expr(f"array_min(transform(filter(paths, p -> p.src = {NONE} and p.dst in {ACCEPTING}), p -> struct(p.cost as cost, p.audit as audit)))")
    top = level.withColumn("best", best).select("*", "best.*").drop("best", "paths")
    # the parts of the repaired text: the audit is cut where the blocks end
    sizes = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("sizes"))
    cut = "conv_id bigint, rank bigint, state int, piece string"
    audits = _renamed(top.select("conv_id", "audit"), "conv_id")
    pieces = _renamed(sizes.join(audits, _same(sizes, audits, "conv_id")).select("conv_id", "audit", "sizes").mapInArrow(_dealt(_arrow(cut)), cut), "conv_id", "rank")
    lines = blocks.select("conv_id", "rank", "lines")
    made = "conv_id bigint, rank bigint, text string"
    texts = lines.join(pieces, _same(lines, pieces, "conv_id", "rank")).select("conv_id", "rank", "lines", "state", "piece").mapInArrow(_texts(_arrow(made)), made)
    hashed = "conv_id bigint, sha string"
    shas = _renamed(texts.repartition("conv_id").sortWithinPartitions("conv_id", "rank").mapInArrow(_hashes(_arrow(hashed)), hashed), "conv_id")
    return top.join(shas, _same(top, shas, "conv_id"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged ``conversations``, repaired. Null roles and texts are one space; other columns are ignored; no rows give none."""
    return repaired(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same by dynamic programming over (rows done, state), a row of every conversation at a time.
OP11_SQL = rf"""
with recursive {sqltext.CRC_TABLE},
fates as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {sqltext.crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as fate
  from conversations, crc_table),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case fate when 0 then [] when 3 then [1, 2] else [1] end) as copy
  from fates),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
told as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as said, lag(role[1]) over (partition by conv_id order by i) || role[1] as pair from placed),
rows as (
  select conv_id, turn, role, text, i, role[1] as initial, pair not in ('su', 'ua', 'au') as illegal,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when said then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault
  from told),
follows(q, c, q2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits as (
  select conv_id, i, q, q2, letter, price, line from (
    select conv_id, i, q, q as q2, 'D' as letter, 4 as price, null as line from rows, (values (0), (1), (2), (3)) s(q)
    union all
    select conv_id, i, q, q2, case when c = initial then 'K' else 'R' end, case when c = initial then 0 else 3 end + case when fault = 'truncated' then 3 else 0 end,
      case when c = initial then role when c = 'u' then 'user' else 'assistant' end || ':' || text
    from rows join follows on c = initial or c in ('u', 'a') where fault not in ('blank', 'duplicate'))),
inserts(q, q2, letters, price, lines) as (values
  (0, 0, '', 0, []::varchar[]), (0, 2, 'I', 3, ['user:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 3, ['user:']), (1, 3, 'II', 6, ['user:', 'assistant:']),
  (2, 2, '', 0, []), (2, 3, 'I', 3, ['assistant:']), (3, 3, '', 0, []), (3, 2, 'I', 3, ['user:'])),
paths as (
  select c.conv_id, cast(0 as bigint) as i, q2 as q, cast(price as bigint) as cost, letters as audit, lines from (select distinct conv_id from rows) c, inserts where q = 0
  union all
  select conv_id, i, q, best.cost, best.audit, best.lines from (
    select p.conv_id, e.i, n.q2 as q, min({{'cost': cast(p.cost + e.price + n.price as bigint), 'audit': p.audit || e.letter || n.letters, 'lines': case when line is null then p.lines else list_append(p.lines, line) end || n.lines}}) as best
    from paths p join edits e on e.conv_id is not distinct from p.conv_id and e.i = p.i + 1 and e.q = p.q join inserts n on n.q = e.q2 group by all)),
counts as (
  select conv_id, count(*) as n, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal
  from rows group by conv_id),
ends as (select p.conv_id, min({{'cost': p.cost, 'audit': p.audit, 'lines': p.lines}}) as best from paths p join counts c on c.conv_id is not distinct from p.conv_id and c.n = p.i where q in (0, 3) group by p.conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id
"""
