import hashlib
import itertools
import random
import re
import zlib

import pytest

from fathomweave.llm import repair
from fathomweave.llm.repair import OP11_SQL, damage, op11_repair, repaired
from tests.llm.common import bag
from tests.oracle import SF, assert_same

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plain(rows):
    """The contract by dynamic programming over (rows done, state), keeping the least (cost, audit) and its lines."""
    out = []
    after = damaged(rows)
    for conv in sorted({r[0] for r in rows}, key=repr):
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        if not own:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        kinds, seen = [], set()
        for _, _, role, text in own:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))

        def ok(lines):
            return re.fullmatch("(s?(ua)*u?|s)", "".join(x[:1] for x in lines))

        best = {"": (0, "", ())}  # last two initials decide what may follow: keep the whole role string's class

        def cls(lines):
            r = "".join(x[:1] for x in lines)
            return "" if not r else r[-1]

        def inserted(states):
            for _ in range(2):
                for cost, audit, lines in list(states.values()):
                    for role in ("user", "assistant"):
                        new = (*lines, f"{role}:")
                        if ok(new):
                            cand = (cost + 3, audit + "I", new)
                            if cls(new) not in states or cand[:2] < states[cls(new)][:2]:
                                states[cls(new)] = cand
            return states

        best = inserted(best)
        for (_, _, role, text), kind in zip(own, kinds, strict=True):
            new = {}
            for cost, audit, lines in best.values():
                choices = [(4, "D", lines)]
                if kind not in ("blank", "duplicate"):
                    more = 3 if kind == "truncated" else 0
                    choices += [(more, "K", (*lines, f"{role}:{text}"))] + [(more + 3, "R", (*lines, f"{x}:{text}")) for x in ("user", "assistant")]
                for price, letter, made in choices:
                    if ok(made):
                        cand = (cost + price, audit + letter, made)
                        if cls(made) not in new or cand[:2] < new[cls(made)][:2]:
                            new[cls(made)] = cand
            best = inserted(new)
        cost, audit, lines = min((x for k, x in best.items() if k in ("", "a")), key=lambda x: x[:2])
        out.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, k string, part int, copies string"


def made(seed, conversations, most=9):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "And then", "", "  \t", "What?", "Fine. ", "it goes on\n", None, "日本."]
    rows = []
    for conv in range(conversations):
        for turn in range(r.randint(0, most)):
            rows.append((conv if conv else None, turn + (turn > 4) if r.random() > 0.1 else None, r.choice(["user", "assistant", "user", "assistant", "system", None, "", "ape"]), r.choice(texts), "k", 1, "c"))
    return rows + rows[:5]


def run(spark, rows):
    return bag(repaired(damage(spark.createDataFrame(rows, SCHEMA))), *COLUMNS)


def test_odd_rows(spark):
    rows = made(1, 120)
    assert run(spark, rows) == plain([r[:4] for r in rows])


def test_no_rows(spark):
    assert run(spark, []) == []


def test_conversations_over_many_blocks(spark, monkeypatch):
    # workers take the block size from the module as they import it, so the long conversation itself has to span blocks
    rows = made(2, 12, 1500)
    assert run(spark, rows) == plain([r[:4] for r in rows])


def test_blocks_join_to_the_same_paths():
    r = random.Random(3)
    for _ in range(200):
        rows = [(r.choice([0, 0, 1, 2]), r.choice("uaus ")) for _ in range(r.randint(1, 12))]
        whole = {s: repair.repair(rows, s) for s in range(4)}
        cuts = sorted(r.randint(0, len(rows)) for _ in range(3))
        blocks = [{s: repair.repair(rows[a:b], s) for s in range(4)} for a, b in itertools.pairwise([0, *cuts, len(rows)])]
        assert {s: repair.joined(blocks, s) for s in range(4)} == whole


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert bag(op11_repair(spark, SF), *COLUMNS) == plain(rows)


@pytest.mark.parametrize("rows", [[(1, 0, "user", "Hi.")] * 40000, [(7, None, "assistant", "x")] * 3000])
def test_one_row_repeated(spark, rows):
    got = run(spark, [(*r, "k", 1, "c") for r in rows])
    assert [g[:8] for g in got] == [p[:8] for p in plain(rows)]


def test_same_rows_as_sql(spark):
    assert_same(spark, op11_repair, OP11_SQL, "/root/testdata/sf0.01")
