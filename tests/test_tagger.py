import itertools
import random

import numpy as np

from fathomweave.functions import annotate, tagger

SAYS = ["The {F} sends the {P} to the {F}.", "Then {F} stores the {P} and derives {K}.", "After that the {F} verifies {P} with the {F}.", "It contains the {P}, which the {F} checks.", "No name is found here at all.", "The {F} derives {K} from {K}."]


def made(seed, names, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text = r.choice(SAYS)
        while "{" in text:
            kind = text[text.index("{") + 1]
            text = text.replace("{" + kind + "}", r.choice(names[kind]), 1)
        out.append(text)
    return out


def lists(seed):
    r = random.Random(seed)
    up = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    return {"F": [up(3) for _ in range(12)], "P": [up(4) + " Id" for _ in range(12)], "K": ["K_" + up(4) for _ in range(12)]}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, k = rng.integers(1, 6), rng.integers(1, 4)
        scores, moves = rng.integers(-5, 6, (n, k)).astype(float), rng.integers(-5, 6, (k, k)).astype(float)
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert value(tagger.viterbi(scores, moves)) == max(map(value, itertools.product(range(k), repeat=n)))


def f1(model, texts, kinds):
    hit = told = want = 0
    for text in texts:
        got = model.names(text)
        gold = [(name, kind) for kind, names in kinds.items() for name in names for _ in range(text.count(name))]
        hit += len([g for g in got if g in gold])
        told, want = told + len(got), want + len(gold)
    return 2 * hit / (told + want)


def test_names_that_no_list_holds(spark):
    """Held out: sentences whose names are none of the lexicon's."""
    known, other = lists(1), lists(2)
    sentences = spark.createDataFrame([(i, t) for i, t in enumerate(made(3, known, 600))] + [(9999, None), (10000, "")], "id int, text string")
    lexicon = spark.createDataFrame([(n, k) for k, ns in known.items() for n in ns], "phrase string, entity_type string")
    model = tagger.fit(sentences, lexicon, most=400)
    held_out = f1(model, made(4, other, 300), other)
    print("F1 of masked names", held_out, "of known ones", f1(model, made(5, known, 200), known))
    assert held_out >= 0.9 and f1(model, made(5, known, 200), known) >= 0.95
    got = annotate.recognise(spark.createDataFrame([(made(6, other, 1)[0],), (None,)], "text string"), "text", "hits", tagger.loader(model)).collect()
    assert got[0]["hits"] is not None and got[1]["hits"] is None and model.names("") == []
