import math
import random
from collections import Counter

from pyspark.sql import functions as F

from fathomweave.operators import mining


def test_sides_are_looked_at_for_frequent_pairs_alone(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["new york", "red", "blue", "green", "old", "stone", "a, b", "x . ! y"]) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", "one", "!", "new york"]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    rows = [r["ws"] for r in docs.where("text is not null").select(mining.words(F.col("text")).alias("ws")).collect()]
    m = Counter(w for ws in rows for w in ws if w)
    n, lefts, rights = Counter(), {}, {}
    for ws in rows:
        for i in range(1, len(ws) - 2):
            if ws[i] and ws[i + 1]:
                pair = ws[i], ws[i + 1]
                n[pair] += 1
                lefts.setdefault(pair, set()).add(ws[i - 1])
                rights.setdefault(pair, set()).add(ws[i + 2])
    pmi = {p: math.log2(n[p] * sum(m.values()) / m[p[0]] / m[p[1]]) for p in n}
    want = {(*p, n[p], len(lefts[p]), len(rights[p]), round(pmi[p], 6)) for p in n if n[p] >= 5 and len(lefts[p]) >= 3 and len(rights[p]) >= 3 and pmi[p] >= 1}
    got = mining.collocations(docs, least_pmi=1.0)
    assert {(*r[:5], round(r[5], 6)) for r in got.collect()} == want and ("new", "york") in {x[:2] for x in want}
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
