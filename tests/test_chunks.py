import random
from collections import Counter, defaultdict
from math import log2

from fathomweave.functions import annotate, chunks
from fathomweave.operators import mining


def test_chunks_join_back(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice(["word ", "end. ", "What? ", "\n", "é日 ", "x" * 30]) for _ in range(r.randint(0, 300)))) for i in range(30)] + [(30, None), (31, ""), (32, "y" * 5000), (33, " \n ")]
    t = spark.createDataFrame(texts, "id int, text string")
    rows = chunks.chunked(t, "id", most=40).collect()
    count = chunks.counter(chunks.default_vocabulary())
    got = defaultdict(list)
    for x in sorted(rows, key=lambda x: (x["id"], x["chunk"])):
        assert x["tokens"] == count(x["text"]) <= 40 and x["start"] == sum(map(len, got[x["id"]])) + 1 and x["length"] == len(x["text"])
        got[x["id"]].append(x["text"])
    assert {i: "".join(v) for i, v in got.items()} == {i: s for i, s in texts if s}
    assert spark.sql(f"select c.tokens from (select 'One two. Three four.' as t) x, lateral chunks(x.t, 3, '{chunks.default_vocabulary()}') c").count() >= 2


def test_vectors_are_weighted_by_tokens(spark):
    t = spark.createDataFrame([(1, "alpha beta. " * 40 + "gamma"), (2, "short")], "id int, text string")
    rows = chunks.chunked(t, "id", most=50)
    got = {x["id"]: x for x in chunks.pooled(rows, "id").collect()}
    parts = rows.where("id = 1").collect()
    want = [sum(annotate.hashed_vector(p["text"])[d] * p["tokens"] for p in parts) / sum(p["tokens"] for p in parts) for d in range(64)]
    assert len(parts) > 2 and max(abs(a - b) for a, b in zip(got[1]["vector"], want, strict=True)) < 1e-6
    assert (got[1]["chunks"], got[1]["total_tokens"], got[1]["max_tokens"]) == (len(parts), sum(p["tokens"] for p in parts), max(p["tokens"] for p in parts))
    assert got[2]["chunks"] == 1


def test_planted_collocations_are_found(spark):
    r = random.Random(2)
    fill = [f"w{i}" for i in range(60)]
    planted = [("mobility", "function"), ("session", "anchor"), ("access", "and"), ("and", "mobility")]
    texts = []
    for i in range(250):
        ws = [r.choice(fill) for _ in range(30)]
        for a in range(0, 30, 10):
            k = r.choice(["mobility function", "session anchor", "access and mobility function", ""])
            ws[a] += f" {k}" + r.choice(["", ".", ","])
        texts.append((i, " ".join(ws)))
    t = spark.createDataFrame([*texts, (1000, None), (1001, ""), (1002, "one")], "id int, text string")
    found = {(x["a"], x["b"]): x for x in mining.collocations(t).collect()}
    assert {("mobility", "function"), ("session", "anchor")} <= set(found)
    # "and" stands between the same two words always: part of a longer string
    assert not {("access", "and"), ("and", "mobility")} & set(found) and len(found) <= len(planted)
    words, pairs = Counter(["one"]), Counter()
    for _, s in texts:
        for run in s.replace(",", ".").split("."):
            ws = run.split()
            words.update(ws)
            pairs.update(zip(ws, ws[1:], strict=False))
    x = found["mobility", "function"]
    n = pairs["mobility", "function"]
    assert x["n"] == n and abs(x["pmi"] - log2(n * sum(words.values()) / words["mobility"] / words["function"])) < 1e-9
    got = Counter(x["phrase"] for x in mining.phrases(t, "id", mining.collocations(t)).collect())
    assert got == {"mobility function": n, "session anchor": pairs["session", "anchor"]}


def test_runs_are_cut_at_the_longest(spark):
    t = spark.createDataFrame([(1, "a b c d e, a b x")], "id int, text string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "a string, b string")
    assert sorted(tuple(x) for x in mining.phrases(t, "id", pairs).collect()) == sorted([(1, 2, "a b c"), (1, 5, "d e"), (1, 8, "a b")])


def test_no_texts(spark):
    t = spark.createDataFrame([], "id int, text string")
    assert mining.collocations(t).count() == 0 and mining.phrases(t, "id", mining.collocations(t)).count() == 0 and chunks.chunked(t, "id").count() == 0


def test_parts_are_counted_from_pieces():
    """Counts of all parts are the tokenizer's own, and a text goes through it about once, not once for each halving."""
    from fathomweave.functions.encode import Encoder, default_tokenizer

    encoder, plain = Encoder(default_tokenizer()), chunks.counter(chunks.default_vocabulary())
    r = random.Random(3)
    kinds = ["word ", "end. ", "What? ", "\n", "\n\n  ", "é日 ", "x" * 30, "a1.b2,", "  ", "\t", "it's ", "<|endoftext|>", "$5%", "'"]
    for i in range(60):
        text = "".join(r.choice(kinds) for _ in range(r.randint(0, 60))) + ("\u00a0z q" if i % 10 == 0 else "")
        count = encoder.between(text)
        for _ in range(40):
            lo = r.randint(0, len(text))
            hi = r.randint(lo, len(text))
            assert count(lo, hi) == plain(text[lo:hi]), (text, lo, hi)
    letters, real = [0], encoder._library
    encoder._library = lambda texts: letters.__setitem__(0, letters[0] + sum(map(len, texts))) or real(texts)
    text = " ".join(f"n{i}q" for i in range(40000))
    parts = list(chunks.spans(text, 64, encoder.between(text)))
    assert "".join(text[a:b] for a, b, _ in parts) == text and len(parts) > 1000 and letters[0] < 3.5 * len(text)
