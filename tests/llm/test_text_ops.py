import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomweave.llm import langid, linededup, mixing, packing, quality, sharding, token_store, toxicity
from fathomweave.llm.encode import Encoder, default_tokenizer, pack
from fathomweave.llm.folds import held_out
from fathomweave.llm.token_store import chunks, placed, powers, read_digests, recipes, reconstruct, verify, write_store
from fathomweave.runtime import new_path
from tests.llm.common import bag, empty, odd, odd_rows, words
from tests.oracle import SF, assert_same


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(tokenizer):
    r = random.Random(3)
    letters = "ab é'sstre.,!?%* \n\t\r  \x0b1²½×_-–€日本🙂́\x1f\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(4000)] + ["a<|endoftext|>b <|endoftext|>.", "don't 'tis I'll.", "", "  ", None, words(3000, 1)]
    small = Encoder(default_tokenizer(), cache=500)
    assert all(small.encode(t) == pack(ids_of(tokenizer, t)) for t in texts)


def test_plain_words_are_merged_by_the_model(tokenizer, monkeypatch):
    letters = [*map(chr, range(0x250)), " ", " "]
    texts = ["".join(c for c in random.Random(i).choices(letters, k=12) if c == " " or c.isalpha() and c not in "ªµº×÷") for i in range(3000)]
    want = [pack(ids_of(tokenizer, t)) for t in texts]
    assert Encoder(default_tokenizer(), cache=500).encode_all(texts) == want
    encoder = Encoder(default_tokenizer())
    monkeypatch.setattr(encoder, "tokenizer", type("ModelAlone", (), {"model": encoder.tokenizer.model}))
    assert encoder.encode("La ville où éléphant") == pack(ids_of(tokenizer, "La ville où éléphant"))


def test_token_store_round_trip(spark, tokenizer):
    rows = odd_rows()
    root = write_store(odd(spark), new_path(spark, "t"))
    assert verify(spark, root)
    got = reconstruct(spark, root).collect()
    want = Counter((d, tuple([*ids_of(tokenizer, t), 0])) for d, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    digests = read_digests(spark, root).orderBy("start").collect()
    at, docs = 0, {r["start"]: r for r in got}
    for r in digests:
        raw = np.array(docs[r["start"]]["ids"], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += r["n_tokens"]
    order = [r["doc_id"] for r in digests]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    keys = [bytes(r["key"]) for r in chunks(spark, root).collect()]
    assert len(keys) == len(set(keys))
    assert read_digests(spark, write_store(empty(spark), new_path(spark, "t"))).count() == 0


def rewritten(spark, folder, change):
    """The parquet table in ``folder`` after ``change``."""
    rows = spark.read.parquet(folder)
    done = spark.createDataFrame(change(rows.collect()), rows.schema)
    done.write.mode("overwrite").parquet(folder)


def test_store_notices_changes(spark):
    def store():
        root = write_store(odd(spark, 12), new_path(spark, "t"))
        assert verify(spark, root) and read_digests(spark, root).count() == 12
        return root

    lost = store()
    rewritten(spark, f"{lost}/chunks/kind=0", lambda rows: rows[1:])
    assert not verify(spark, lost)
    for read in (read_digests, reconstruct):
        with pytest.raises(Exception, match="a chunk is missing"):
            read(spark, lost).collect()
    altered = store()
    rewritten(spark, f"{altered}/chunks/kind=0", lambda rows: [(rows[0]["key"], *rows[1][1:])] + [tuple(r) for r in rows[1:]])
    with pytest.raises(Exception, match="its address"):
        read_digests(spark, altered).collect()
    for change in (lambda rows: rows[1:], lambda rows: [tuple({**r.asDict(), "doc_id": r["doc_id"] if i else 999}.values()) for i, r in enumerate(rows)]):
        changed = store()
        rewritten(spark, f"{changed}/recipes", change)
        assert not verify(spark, changed)
        with pytest.raises(ValueError, match="manifest"):
            read_digests(spark, changed)


def test_order_follows_content(spark):
    found = set()
    for parts in (1, 3, 7):
        root = write_store(odd(spark).repartition(parts), new_path(spark, "t"))
        found.add(tuple(tuple(r) for r in read_digests(spark, root).orderBy("start").collect()))
    assert len(found) == 1


def test_crc_shift():
    a, b = b"some ids", b"12345678" * 3
    from fathomweave.llm.token_store import _times, moved

    long = b"1234" * 70001
    assert int(moved(np.array([zlib.crc32(a)]), np.array([70001]))[0]) ^ zlib.crc32(long) == zlib.crc32(a + long)

    assert _times(powers(6)[6], zlib.crc32(a)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_fullest_equals_brute_force():
    r = random.Random(1)
    for _ in range(60):
        counts, room = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}, r.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        found = packing.fullest(counts, room)
        assert sum(a * b for a, b in found) == max(sums) and all(b <= counts[a] for a, b in found)


def test_packing(spark, tokenizer):
    rows = odd_rows()
    got = packing.pack(odd(spark), room=256).collect()
    total = sum(len(ids_of(tokenizer, t)) + 1 for _, t, *_ in rows)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for ps in places.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in got) == total and len(places) <= -(-total // 256) + 3
    want = Counter()
    for d, t, *_ in rows:
        raw = np.array([*ids_of(tokenizer, t), 2], "<u4")
        at, to = 0, len(raw) % 256 or 256
        for k in range(-(-len(raw) // 256)):
            want[d, k, at, to - at, zlib.crc32(raw[at:to].tobytes())] += 1
            at, to = to, to + 256
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.pack(empty(spark)).count() == 0


def test_language(spark):
    r = random.Random(0)
    made = {"en": "the of and that with ing tion", "de": "der und schaft ung ich ein", "fr": "les eaux que ment dans une"}
    rows = [(i, " ".join(r.choice(made[k].split()) for _ in range(30)), k) for i, k in enumerate(list(made) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).collect()
    truth = {i: k for i, _, k in rows}
    assert all(x["lang_pred"] == truth[x["doc_id"]] and 0 <= x["score"] <= 1 for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    model = langid.fit(docs)
    out = langid.identify(odd(spark), model).collect()
    assert len(out) == len(odd_rows())
    lettered = lambda t: bool(t) and any(c.isalpha() for c in t)
    assert Counter((x["doc_id"], x["lang_pred"] == "und") for x in out) == Counter((d, not lettered(t)) for d, t, *_ in odd_rows())
    assert langid.fit(empty(spark)) is None and langid.identify(odd(spark), None).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty(spark), model).count() == 0


def test_code_length_by_definition():
    text = b"abracadabra abracadabra"
    model = langid.train({"x": [text]}, order=2)
    s = [32, 32, *text]
    seen = {}
    for i in range(2, len(s)):
        for k in range(3):
            seen.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1

    def share(context, c):
        if context not in seen:
            return share(context[1:], c)
        n, kinds = sum(seen[context].values()), len(seen[context])
        if seen[context][c]:
            return seen[context][c] / (n + kinds)
        return kinds / (n + kinds) * (share(context[1:], c) if context else 1 / 256)

    other = b"cab bard xyz"
    t = [32, 32, *other]
    want = sum(-np.log2(share(tuple(t[i - 2 : i]), t[i])) for i in range(2, len(t)))
    got = model.code_lengths([text, other, b"c"])
    assert abs(got[1, 0] - want) < 1e-6 and abs(got[2, 0] + np.log2(share((32, 32), 99))) < 1e-6
    long = (text + other) * 5000
    whole = model.code_lengths([long])[0, 0]
    seen_blocks = []
    model.verdict = lambda total: seen_blocks.append(total[0])
    langid.BLOCK, kept = 1 << 14, langid.BLOCK
    model.predict(long)
    langid.BLOCK = kept
    assert abs(seen_blocks[0] - whole) < 1e-3


def test_order_stays_with_many_languages():
    r = random.Random(8)
    scripts = [range(0x61, 0x7B)] * 6 + [range(0x430, 0x450)] * 2 + [range(0x3B1, 0x3CA), range(0x4E00, 0x4E60)]
    lists = [["".join(chr(r.choice(s)) for _ in range(r.randint(2, 6))) for _ in range(40)] for s in scripts]
    speak = lambda k, n: " ".join(r.choice(lists[k]) for _ in range(n)).encode()
    model = langid.train({f"l{k}": [speak(k, 80) for _ in range(10)] for k in range(len(scripts))})
    assert model.order == 3 and all(len(t.windows) == 4 for t in model.trees)
    for k in range(len(scripts)):
        assert all(model.predict(speak(k, 30))[0] == f"l{k}" for _ in range(5))
    with pytest.raises(ValueError):
        langid.train({"x": [b"a"]}, order=8)


def test_languages_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op3_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count() > 0


def measured(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    hit = {j for i in range(len(ws) - 2) if grams[ws[i], ws[i + 1], ws[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(hit)


def test_quality(spark):
    assert_same(spark, quality.op4_quality, quality.OP4_SQL)
    book = quality.ledger(odd(spark))
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in book.collect())
    assert got == Counter((d, *measured(t)) for d, t, *_ in odd_rows())
    text = "a b c a b c x " + words(400, 1) + " a b c"
    pairs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    quality.PLACE_BITS, kept = 6, quality.PLACE_BITS  # the way of texts too long for packed places
    try:
        assert quality.ledger(pairs).first()["n_repeat_words"] == measured(text)[4]
    finally:
        quality.PLACE_BITS = kept
    v1 = quality.POLICIES["v1"]
    rows = quality.apply_policy(book, v1).collect()
    for r in quality.ablations(book, v1).collect():
        bit = 1 << next(b for b, name, _ in quality.RULES if name == r["rule"])
        assert r["failed"] == sum(bool(x["fail_bits"] & bit) for x in rows)
        assert r["only_this"] == sum(x["fail_bits"] & v1.mask == bit for x in rows)
    assert quality.ledger(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [3000, 20000, 1 << 22])
def test_sharding(spark, limit):
    assert_same(spark, lambda s, d: sharding.shard(s.read.parquet(f"{d}/documents.parquet"), limit), sharding.oracle(limit))
    got = sharding.shard(odd(spark), limit).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((d, len((t or "").encode())) for d, t, *_ in odd_rows())
    size, rows = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        rows[r["shard"]] += 1
    assert all(size[k] <= limit or rows[k] == 1 for k in size)
    assert all(r["shard_bytes"] == size[r["shard"]] and r["shard_docs"] == rows[r["shard"]] and len(r["shard"]) == r["depth"] for r in got)
    assert not any(a != b and b.startswith(a) for a in size for b in size)
    assert sharding.shard(empty(spark), limit).count() == 0


def test_written_shards_hold_every_row(spark):
    rows = [*odd_rows(), *odd_rows()[:2]]
    docs = spark.createDataFrame(rows, odd(spark).schema).withColumn("shard", F.lit(5)).withColumn("path", F.lit("p"))
    folder = new_path(spark, "shards")
    sharding.write_shards(docs, folder, 200)
    back = spark.read.parquet(folder)
    plain = lambda df: Counter(map(repr, df.collect()))
    assert plain(back.withColumn("shard", F.col("shard_")).select(docs.columns)) == plain(docs)
    assert back.select("shard").distinct().count() > 1


def test_one_key_is_split(spark):
    docs = spark.createDataFrame([(7, "x" * 100)] * 200, "doc_id bigint, text string")
    sizes = Counter(r["shard"] for r in sharding.shard(docs, 2000).collect())
    assert len(sizes) > 8 and max(sizes.values()) <= 20 and sum(sizes.values()) == 200


def filled(sizes):
    """Targets by the words of the contract: share, stop at three times, share the excess again."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    w = {k: (1, 2, 3)[i % 3] for i, k in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in order if k not in fixed]
        rest = total - sum(fixed.values())
        share = {k: rest * w[k] / sum(w[x] for x in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: 3.0 * sizes[k] for k in over}


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(9000 + i, words(30, i), "en", None, 1) for i in range(40)] + [(9100, "few words", "en", "tiny", 1), (9101, "", "en", "none", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = mixing.decide(docs).collect()
    size, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    want, most = filled(size), max(r["size"] for r in got)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == size[r["source"]]
    assert all(abs(taken[k] - want[k]) <= most / 2 + 1 for k in size)
    assert bag(mixing.decide(docs.repartition(5)), "doc_id", "copies") == bag(mixing.decide(docs), "doc_id", "copies")
    out = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert out == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mixing_groups_and_repeats(spark):
    mixing.FAN_IN, kept = 4, mixing.FAN_IN
    try:
        rows = [(i, words(5 + i % 17, i), f"s{i % 3}") for i in range(200)] + [(1000, words(9, 1), "s0")] * 50
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        got = mixing.decide(docs).collect()
        assert len(got) == 250
        taken, target = Counter(), {}
        for r in got:
            taken[r["source"]] += r["size"] * r["copies"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[k] - target[k]) <= 12 for k in target)
    finally:
        mixing.FAN_IN = kept
    odd_got = mixing.decide(odd(spark)).collect()
    assert Counter((r["doc_id"], r["source"]) for r in odd_got) == Counter((d, s) for d, _, _, s, *_ in odd_rows())
    assert mixing.mix(odd(spark)).columns == odd(spark).columns and mixing.decide(empty(spark)).count() == mixing.mix(empty(spark)).count() == 0


def test_mix_gives_what_was_decided(spark):
    rows = [(5, "one two three", "a", k) for k in range(101)] + [(5, "one two four", "a", 0)] * 3 + [(None, "x y", None, 1)] * 7 + [(k, words(20 + k % 7, k), "bc"[k % 2], 0) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int").repartition(3)
    want = Counter()
    for r in mixing.decide(docs).join(docs.selectExpr("doc_id as d", "text", "source as s", "xxhash64(text) as x").distinct(), __import__("pyspark").sql.functions.expr("doc_id <=> d and source <=> s and mark = x")).collect():
        want[r["doc_id"], r["text"], r["source"]] += r["copies"]
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == +want and want[5, "one two three", "a"] > 0
    each = Counter((r["doc_id"], r["text"], r["copies"]) for r in got if r["text"] == "one two three")
    assert max(each.values()) - (min(each.values()) if len(each) == 101 else 0) <= 1
    assert mixing.mix(empty(spark)).count() == 0


def test_rounding_keeps_expectation(spark):
    docs = spark.createDataFrame([(i, words(10, i), "a" if i < 60 else "b") for i in range(90)], "doc_id bigint, text string, source string")
    times = Counter()
    for seed in range(12):
        for r in mixing.decide(docs, seed=seed).where("source = 'a'").collect():
            times[r["doc_id"]] += r["copies"]
    # a: 600 of 900 words at weight 1 of 3, so each document is taken half of the time
    assert abs(sum(times.values()) / 12 - 30) < 1 and 0 <= min(times.values()) and max(times.values()) <= 12 and len(times) > 50


def test_toxicity(spark):
    r = random.Random(0)
    plain, bad = [f"w{i}" for i in range(300)], ["loserix", "stemschaft", "stemung", "stemlich"]
    rows, marks = [], []
    for i in range(700):
        ws = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if toxic := i % 4 == 0:
            ws[r.randrange(len(ws))] = r.choice(bad)
        rows.append((i, " ".join(ws), "en"))
        marks.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    net = toxicity.fit(docs, labels)
    got = toxicity.score(docs, net).collect()
    held = [x for x in got if x["held_out"]]
    assert sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    assert toxicity.logits(net, ["stemheit w1 w2 w3"])[0] > toxicity.logits(net, ["w1 w2 w3 w4"])[0]  # an ending not seen before
    out = toxicity.score(odd(spark), net).collect()
    assert len(out) == len(odd_rows()) and all(x["score"] == 0 for x in out if x["doc_id"] in (4, 5, 6, 7, 13))
    kept = toxicity.reject(odd(spark), net)
    assert kept.columns == odd(spark).columns and kept.count() == sum(x["score"] < 0.5 for x in out)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(empty(spark), labels) is None
    assert toxicity.score(odd(spark), None).where("score > 0").count() == 0 and toxicity.score(empty(spark), net).count() == 0
    odd_labels = spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 0, 1), (0, 0, 0), (0, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(odd(spark), toxicity.fit(odd(spark), odd_labels)).count() == len(odd_rows())


def test_blocks_do_not_matter():
    net = toxicity.train([words(50, i) for i in range(20)], [i % 2 for i in range(20)], [1.0] * 20, epochs=1)
    texts = [words(n, n) for n in (1, 2, 3, 50, 400)] + ["", "?!"]
    whole = toxicity.logits(net, texts)
    assert np.allclose(whole[:5], [toxicity.logits(net, [t])[0] for t in texts[:5]], atol=1e-5) and np.isinf(whole[5:]).all()
    toxicity.BLOCK, toxicity.KEPT_WORDS, kept = 64, 100, (toxicity.BLOCK, toxicity.KEPT_WORDS)
    assert np.allclose(toxicity.logits(net, texts)[:5], whole[:5], atol=1e-5)
    toxicity.BLOCK, toxicity.KEPT_WORDS = kept


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id bigint")
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in df.select("doc_id", held_out().alias("h")).collect())


def test_line_dedup(spark):
    assert_same(spark, linededup.op10_line_dedup, linededup.OP10_SQL)
    rows = [(i, f"own {i}\nmenu\n\n  \nmenu\nrare {i // 8}", "a") for i in range(40)] + [(100 + i, "menu\nelsewhere", "b") for i in range(3)] + [(200, None, None), (201, "", None), (202, "menu", None)] + [(300, "own 0\nmenu", "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' as host", "1 as _bad_")
    done = {(r["doc_id"], r["text"], r["_lines"], r["_dropped"]) for r in linededup.drop_boilerplate(docs, ratio=0.3).collect()}
    assert (8, "own 8\n\n  \nrare 1", 6, 2) in done and (100, "menu\nelsewhere", 2, 0) in done and (200, None) in {x[:2] for x in done} and (202, "menu", 1, 0) in done and (300, "own 0", 2, 1) in done
    assert linededup.drop_boilerplate(docs).count() == len(rows)
    assert linededup.drop_boilerplate(odd(spark)).count() == len(odd_rows()) and linededup.drop_boilerplate(empty(spark)).count() == 0
    hosts = spark.createDataFrame([("https://m.Example.org:8080/a?b",), ("no url",), (None,)], "url string").select(linededup.host_of("url").alias("h"))
    assert [r["h"] for r in hosts.collect()] == ["m.example.org", None, None]


def test_all_of_a_long_run_counts():
    import zlib

    runs = [words(12, i).replace(" ", "") for i in range(70)]
    put = lambda r, k: r[:k] + "foulterm" + r[k:]
    net = toxicity.train([*runs[:50], *[put(r, 13 * i % 90) for i, r in enumerate(runs[:50])]], [0] * 50 + [1] * 50, [1.0] * 100, epochs=20)
    for k in (10, 70, 90, 200):
        assert all(toxicity.logits(net, [put(r, k)])[0] > toxicity.logits(net, [r])[0] + 1 for r in runs[50:]), k
    for n in (0, 1, 63, 64, 65, 111, 112, 113, 160, 161, 1000):
        run = "".join(chr(97 + zlib.crc32(bytes([i % 251, i // 251])) % 26) for i in range(n))
        pieces = toxicity.words_of(f"short {run} 日本")
        assert pieces[0] == "short" and pieces[-1] == "日本" and max(map(len, pieces)) <= 64
        assert all(any(run[i : i + 16] in p for p in pieces) for i in range(max(1, n - 15)))


def test_store_spreads_equal_documents(spark, tmp_path):
    """Recipes of equal documents have one key; they don't go through one task, and each is kept."""
    docs = spark.range(3000).selectExpr("id as doc_id", "'the same few words' as text").repartition(4)
    root = token_store.write_store(docs, str(tmp_path / "store"))
    assert spark.read.parquet(f"{root}/chunks/kind=0").count() == 1
    assert token_store.read_digests(spark, root).selectExpr("count(*)", "count(distinct start)").first()[:] == (3000, 3000)
    plan = docs.sparkSession.read.parquet(f"{root}/recipes").groupBy("part").count().agg({"count": "max"}).first()[0]
    assert plan < 3000


def test_toxicity_takes_one_text_of_an_id(spark):
    """A labelled id that many rows share adds one text to the sample, the same on every run."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, ("bad awful vile " if i % 2 else "good calm kind ") + words(20, i)) for i in ids] + [(ids[0], f"other text {k}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, toxic int")
    seen = []
    real = toxicity.train

    def train(texts, *a, **k):
        seen.append(len(texts))
        return real(texts, *a, **k)

    toxicity.train, before = train, toxicity.train
    try:
        assert toxicity.fit(docs, labels) is not None
    finally:
        toxicity.train = before
    assert max(seen) == len(ids)


def test_registered_sharding_splits(spark):
    assert sharding.op5_sharding(spark, "/root/testdata/sf0.01").select("shard").distinct().count() > 3


def test_quality_with_equal_hashes(spark, monkeypatch):
    """Windows that differ but share a hash, standing between equal ones, hide no repeat."""
    monkeypatch.setattr(quality, "DIGEST", "xxhash64(length(get(ws, i)))")
    r = random.Random(8)
    texts = [(i, " ".join(r.choice(["a", "b", "cc"]) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(60, "a x y b x y c x y a x y"), (61, None)]

    def repeats(text):
        ws = (text or "").split()
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        n = Counter(grams)
        return len({j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)})

    got = {x["doc_id"]: x["n_repeat_words"] for x in quality.ledger(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == {i: repeats(t) for i, t in texts}


def test_long_lists_of_boilerplate(spark):
    """A site with some thousand boilerplate lines is searched by halving; the same lines go."""
    common = [f"common line {i}" for i in range(1500)]
    rows = [(k, "\n".join(common[: 300 * (k + 1)] + [f"own {k} {i}" for i in range(50)]), "s") for k in range(5)] + [(9, "\n".join(f"x{i}" for i in range(70)), None)] * 6
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    # on all five pages and over the ratio: the first 300
    assert all(got[k]["_dropped"] == 300 and got[k]["text"].split("\n")[-1] == f"own {k} 49" for k in range(5))
    assert got[9]["text"] == "" and got[9]["_dropped"] == 70
