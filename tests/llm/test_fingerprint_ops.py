import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomweave.llm import components, fingerprints, neardup, simhash
from tests.llm.common import bag, empty, odd, odd_rows, words


def groups(keys, linked):
    up = {k: k for k in keys}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ks = sorted(keys)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            if linked(a, b) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    r = random.Random(0)
    for _ in range(3000):
        flips = r.sample(range(64), radius)
        assert any(not any(m >> f & 1 for f in flips) for m in masks)


def test_fingerprint_by_definition():
    import xxhash

    for text in ("A b c d", "one", "Two words", "x y z " * 40, "É b c d"):
        ws = [w for w in text.translate({i: i + 32 for i in range(65, 91)}).replace("\n", " ").split(" ") if w]
        grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_components_equal_brute_force(spark, radius):
    r = random.Random(radius)
    values = {r.getrandbits(64) for _ in range(40)}
    for v in list(values)[:15]:
        for _ in range(8):
            values.add(v ^ sum(1 << b for b in set(r.choices(range(64), k=r.randint(1, 3)))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp bigint"), radius)
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    want = groups(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= radius)
    same = lambda f: {frozenset(k for k in signed if f(k) == f(v)) for v in signed}
    assert same(lambda k: got.get(k, k)) == same(want.get)


def test_simhash_odd_rows(spark):
    rows = odd_rows()
    got = simhash.simhash_components(odd(spark)).collect()
    assert len(got) == len(rows)
    prints = {t: f"{simhash.fingerprint(t):016x}" for _, t, *_ in rows}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((d is None, d or 0, prints[t]) for d, t, *_ in rows)
    want = groups(set(prints.values()), lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1") <= 2)
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[want[prints[t]]] = min(d, least.get(want[prints[t]], d))
    assert all(r["component_id"] == least[want[r["fingerprint"]]] for r in got)
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (None, 3), (5, 6)], "u bigint, v bigint")
    got = components.connected_components(edges).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


def jaccard_groups(texts, size=5, least=0.8):
    sets = {k: frozenset(neardup.shingles(t, size).tolist()) for k, t in texts.items()}
    return groups(sets, lambda a, b: sets[a] == sets[b] or bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


def test_near_copies_equal_brute_force(spark):
    r = random.Random(5)
    texts, k = {}, 0
    for g in range(30):
        base = words(r.randint(20, 300), 100 + g).split()
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = f"new{r.random()}"
            texts[k] = " ".join(own)
            k += 1
    docs = spark.createDataFrame([(k, t, "x", None) for k, t in texts.items()], "doc_id bigint, text string, node string, prints string")
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns
    want = jaccard_groups(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def kept_ids(spark, texts):
    return sorted(r["doc_id"] for r in neardup.dedup(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect())


def test_pairs_in_a_crowd_that_shares_a_passage(spark):
    passage, texts = words(150, 1).split(), {}
    for i in range(400):
        own = words(70, 1000 + i).split()
        texts[i] = " ".join(passage + own)
        if i % 5 == 0:
            # the last 22 words differ: a similarity of just over 0.8
            texts[10000 + i] = " ".join(passage + own[:-22] + words(22, 5000 + i).split())
    want = sorted(set(jaccard_groups(texts).values()))
    assert len(want) == 400
    assert kept_ids(spark, texts) == want


@pytest.mark.parametrize("volume", [1 << 18, 1 << 12])
def test_blocks_of_a_crowd_meet(spark, monkeypatch, volume):
    monkeypatch.setattr(neardup, "VOLUME", volume)
    passage, texts = words(150, 1).split(), {}
    for i in range(120):
        own = words(70, 1000 + i).split()
        texts[i], texts[1000 + i] = " ".join(passage + own), " ".join(passage + own[:-20] + words(20, 5000 + i).split())
    assert kept_ids(spark, texts) == sorted(set(jaccard_groups(texts).values()))


def test_chain_in_a_crowd_is_one_group(spark):
    passage, own = words(150, 1).split(), words(3000, 2).split()
    texts = {i: " ".join(passage + own[22 * i : 22 * i + 100]) for i in range(130)}
    alone = {i: " ".join(passage + words(100, 3000 + i).split()) for i in range(1000, 1100)}
    assert set(jaccard_groups(texts).values()) == {0} and len(set(jaccard_groups({0: texts[0], 2: texts[2]}).values())) == 2
    assert kept_ids(spark, texts | alone) == [0, *alone]


def test_near_copies_odd_rows(spark):
    kept = bag(neardup.dedup(odd(spark)), "doc_id", "text")
    by = {i: t for i, (_, t, *_) in enumerate(odd_rows())}
    want = jaccard_groups(by)
    ids = [d for d, *_ in odd_rows()]
    first = {g: min((ids[i] is None, ids[i] or 0) for i in want if want[i] == g) for g in set(want.values())}
    assert sorted((d is None, d or 0) for d, _ in kept) == sorted(first.values())
    assert neardup.dedup(empty(spark)).count() == 0


def test_weighted_prints_find_pairs():
    r = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        common, own = r.integers(0, 1 << 63, 90, np.uint64), r.integers(0, 1 << 63, (2, 10), np.uint64)
        a, b = (neardup.weighted_prints(np.unique(np.concatenate([common, x]))) for x in own)
        missed += not any(bin((x ^ y) & (1 << 64) - 1).count("1") <= neardup.RADIUS for x, y in zip(a, b, strict=True))
    assert missed <= 2


def similar_sets(seed, count=60):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(count // 4):
        base = r.integers(0, 1 << 63, int(r.integers(1, 700)), np.uint64)
        for _ in range(4):
            k = int(r.integers(0, max(1, len(base) // 6) + 1))
            out.append(np.unique(np.concatenate([base[k:], r.integers(0, 1 << 63, int(r.integers(0, k + 1)), np.uint64)])))
    return [x for x in out if len(x)]


def test_odd_sketches_rule_no_pair_out():
    sets = similar_sets(4)
    sketches, n = [np.frombuffer(neardup.odd_sketch(x), "<u8") for x in sets], np.array([len(x) for x in sets])
    def alike(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return both >= 0.8 * (n[i] + n[j] - both)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j)]
    assert len(pairs) > 20
    for i, j in pairs:
        got = neardup.survivors(n[[i, j]], np.array([0, 1]), np.array([0, 0]), [sketches[i], sketches[j]], 0.8)
        assert got.all(), (i, j)
    kept = neardup.survivors(n, np.arange(len(n)), np.zeros(len(n), int), sketches, 0.8)
    assert kept[sorted({k for p in pairs for k in p})].all()
    # those of one group, or of one of two blocks, have nothing to be compared with
    assert not neardup.survivors(n, np.zeros(len(n)), np.zeros(len(n), int), sketches, 0.8).any()
    halves = neardup.survivors(n, np.arange(len(n)), np.arange(len(n)) % 2, sketches, 0.8)
    assert halves[[k for i, j in pairs if i % 2 != j % 2 for k in (i, j)]].all() and halves.sum() <= kept.sum()


def test_repeated_rows_with_other_columns_stay_one(spark):
    rows = [(1, words(30, 1), k, {"a": k}) for k in (3, 1, 2)] + [(None, words(30, 2), 5, None)] * 2
    kept = neardup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string, d int, h map<string,int>"))
    assert kept.columns == ["doc_id", "text", "d", "h"]
    got = sorted(((r["doc_id"], r["d"]) for r in kept.collect()), key=repr)
    again = neardup.dedup(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, d int, h map<string,int>").repartition(3))
    assert len(got) == 2 and got == sorted(((r["doc_id"], r["d"]) for r in again.collect()), key=repr)


def test_fingerprints_digest(spark):
    rows = odd_rows()
    got = fingerprints.compare_with_next(odd(spark)).collect()
    assert len(got) == len(rows)
    plain = [(d, t) for d, t, *_ in rows if d is not None and d not in (0, 4, 11)]
    texts = dict(plain)
    order = sorted(texts)
    by = {r["doc_id"]: r for r in got}
    for a, b in zip(order, order[1:], strict=False):
        if b != a + 1:
            continue
        t, u = texts[a] or "", texts[b] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert by[a]["n_chars"] == len(t) and by[a]["sha"] == hashlib.sha256(edited.encode()).hexdigest(), a
    same = {}
    for r in got:
        same.setdefault(r["doc_id"], set()).add((r["f0"], r["f1"]))
    assert same[0] == same[1] and (0, 0) in same[6]
    assert fingerprints.compare_with_next(empty(spark)).count() == 0
    one = fingerprints.compare_with_next(odd(spark, 1)).collect()
    assert len(one) == 1 and (one[0]["n0"], one[0]["n1"]) == (one[0]["f0"], one[0]["f1"])


def test_votes_by_definition(spark):
    def hashed(values):
        df = spark.createDataFrame([(v,) for v in values], "h bigint")
        return [r[0] for r in df.selectExpr("xxhash64(1, h)").collect()]

    text = "Alpha be gamma alpha be of is Omega"
    ts = spark.sql(f"select inline({fingerprints.terms(repr(text))})").collect()
    both = list(zip([t["h"] for t in ts], hashed([t["h"] for t in ts]), [t["w"] for t in ts], strict=True))
    total = sum(w for *_, w in both)
    want = [sum(1 << b for b in range(64) if 2 * sum(w for *hs, w in both if hs[k] >> b & 1) > total) for k in range(2)]
    got = fingerprints.fingerprint(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first()
    assert [x & (1 << 64) - 1 for x in (got["f0"], got["f1"])] == want


@pytest.mark.parametrize("radius", [1, 2])
def test_near_classes_equal_brute_force(spark, radius):
    r = random.Random(radius)
    values = [r.getrandbits(128) for _ in range(30)]
    for v in values[:12]:
        for _ in range(6):
            values.append(v ^ sum(1 << b for b in set(r.choices(range(128), k=r.randint(0, 3)))))
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(sign(v & (1 << 64) - 1), sign(v >> 64), i) for i, v in enumerate(values)]
    got = {(r["f0"], r["f1"]): r["near_class"] for r in fingerprints.near_classes(spark.createDataFrame(rows, "f0 bigint, f1 bigint, doc_id bigint"), radius).collect()}
    want = groups(range(len(values)), lambda a, b: bin(values[a] ^ values[b]).count("1") <= radius)
    assert all(got[(a, b)] == want[i] for a, b, i in rows)


def test_near_classes_hold_near_copies(spark):
    r, texts = random.Random(3), {}
    for i in range(40):
        base = words(200, 700 + i).split()
        for k in range(3):
            own = list(base)
            own[r.randrange(200)] = f"new{i}{k}"
            texts[10 * i + k] = " ".join(own)
    prints = fingerprints.fingerprint(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), ["doc_id"])
    rows = prints.collect()
    values = {x["doc_id"]: (x["f0"] & (1 << 64) - 1) | (x["f1"] & (1 << 64) - 1) << 64 for x in rows}
    got = {(x["f0"], x["f1"]): x["near_class"] for x in fingerprints.near_classes(spark.createDataFrame(rows, "doc_id bigint, f0 bigint, f1 bigint")).collect()}
    want = groups(set(values), lambda a, b: bin(values[a] ^ values[b]).count("1") <= fingerprints.RADIUS)
    assert {x["doc_id"]: got[(x["f0"], x["f1"])] for x in rows} == want
    assert sum(want[d] == d // 10 * 10 for d in want) >= 0.9 * len(want)


@pytest.mark.parametrize("radius", [0, 6, 11])
def test_wide_near_classes_equal_brute_force(spark, radius):
    r = random.Random(radius)
    values = [r.getrandbits(128) for _ in range(20)]
    for v in values[:8]:
        for _ in range(25):
            values.append(v ^ sum(1 << b for b in r.sample(range(128), r.randint(0, radius))))
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(sign(v & (1 << 64) - 1), sign(v >> 64), i) for i, v in enumerate(values)]
    got = {(r["f0"], r["f1"]): r["near_class"] for r in fingerprints.near_classes(spark.createDataFrame(rows, "f0 bigint, f1 bigint, doc_id bigint"), radius).collect()}
    want = groups(range(len(values)), lambda a, b: bin(values[a] ^ values[b]).count("1") <= radius)
    assert all(got[(a, b)] == want[i] for a, b, i in rows)


def test_registered_query_equals_brute_force(spark):
    import math

    from tests.oracle import SF

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in fingerprints.op9_fingerprints(spark, SF).collect()}
    assert set(rows) == set(docs)
    order = sorted(docs)
    number = {d: int(rows[d]["fingerprint"], 16) for d in order}
    like = lambda a, b: max(0.0, min(1.0, math.cos(math.pi * bin(a ^ b).count("1") / 128)))
    edited = {}
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        text, half = docs[d], len(docs[d]) // 2
        edited[d] = text[: len(text) - half] + docs[after][:half]
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited[d].encode()).hexdigest())
        assert math.isclose(r["near_next"], like(number[d], number[after]), abs_tol=1e-12)
        assert math.isclose(r["near_edited"], like(number[d], int(r["edited_fingerprint"], 16)), abs_tol=1e-12)
    prints = fingerprints.fingerprint(spark.createDataFrame(list(edited.items()), "doc_id bigint, text string"), ["doc_id"]).select("doc_id", fingerprints.text_of("f0", "f1").alias("f")).collect()
    assert all(rows[r["doc_id"]]["edited_fingerprint"] == r["f"] for r in prints)
    want = groups(set(order), lambda a, b: bin(number[a] ^ number[b]).count("1") <= fingerprints.RADIUS)
    assert {d: rows[d]["near_class"] for d in order} == want


@pytest.mark.parametrize(("per", "parts"), [(3, 4), (5, 100), (1, 7), (4000, 4096)])
def test_next_over_ranges_of_two_levels(spark, monkeypatch, per, parts):
    monkeypatch.setattr(fingerprints, "PER_BUCKET", per)
    monkeypatch.setattr(fingerprints, "MOST_PARTS", parts)
    r = random.Random(per)
    ids = r.sample(range(-500, 5000), 47)
    for docs in (ids, [*ids, None], [7], [7, 8], [None]):
        rows = [(i, f"text {i}") for i in docs]
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = {x["doc_id"]: x["next_text"] for x in fingerprints.beside_next(df).where("not ghost").collect()}
        order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
        assert got == {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}


@pytest.mark.parametrize(("depth", "small", "hot"), [(3, 3, 1), (4, 4, 2), (3, 16, 1)])
def test_keys_of_more_blocks_equal_brute_force(spark, monkeypatch, depth, small, hot):
    """Large buckets are cut again on further blocks, hot keys meet no window; crowds of several groups stay whole."""
    monkeypatch.setattr(fingerprints, "_depth", lambda n, radius: depth)
    monkeypatch.setattr(fingerprints, "SMALL", small)
    monkeypatch.setattr(fingerprints, "HOT", hot)
    monkeypatch.setattr(fingerprints, "SAMPLE", 2)
    r = random.Random(depth)
    base = r.getrandbits(128)
    # crowds that agree on most blocks, some of them too far apart to be one group
    far = [base ^ (r.getrandbits(40) << 88) for _ in range(6)] + [r.getrandbits(128) for _ in range(20)]
    values = far + [v ^ sum(1 << b for b in r.sample(range(128), r.randint(0, 9))) for v in far[:6] for _ in range(25)]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(sign(v & (1 << 64) - 1), sign(v >> 64), i) for i, v in enumerate(values)]
    got = {(x["f0"], x["f1"]): x["near_class"] for x in fingerprints.near_classes(spark.createDataFrame(rows, "f0 bigint, f1 bigint, doc_id bigint")).collect()}
    want = groups(range(len(values)), lambda a, b: bin(values[a] ^ values[b]).count("1") <= fingerprints.RADIUS)
    assert all(got[(a, b)] == want[i] for a, b, i in rows)


def test_depth_follows_the_number_of_fingerprints():
    """Twice as many bits as before are agreed on long before unlike fingerprints fill the buckets."""
    for n in (250_000, 4_000_000, 10**9, 10**12):
        d = fingerprints._depth(n, 11)
        assert 1 << d * 128 // (11 + d) >= n // 2
    assert fingerprints._depth(250_000, 11) == 2 and fingerprints._depth(4_000_000, 11) == 3


def test_pairs_within_a_block_of_a_crowd(spark, monkeypatch):
    """Pairs that meet in one crowd alone, both of them in one block or in two."""
    monkeypatch.setattr(neardup, "VOLUME", 2000)
    r = np.random.default_rng(8)
    rows = []
    for i in range(60):
        base = r.integers(0, 1 << 63, 100, np.uint64)
        for k in range(2):
            h = np.unique(np.concatenate([base[:95], r.integers(0, 1 << 63, 5, np.uint64)]))
            rows.append((2 * i + k, len(h), bytearray(neardup.odd_sketch(h)), bytearray(np.unique((h & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes())))
    nodes = spark.createDataFrame(rows, "node bigint, n bigint, odd binary, ids binary")
    crowds = nodes.select(F.lit(7).cast("bigint").alias("key"), "node", F.col("node").alias("component"))
    links, path = neardup._crowd_links(crowds, nodes, 0.8)
    found = {tuple(sorted(x)) for x in links.collect()}
    neardup.drop_table(spark, path)
    assert found == {(2 * i, 2 * i + 1) for i in range(60)}
