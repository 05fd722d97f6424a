"""Matching of short and long texts and of vectors against loops over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from emberline.operators.matching import best_products, carriers, contained_pairs
from emberline.operators.texts import jaccard_brief, neighbourhood, quote_grounding

SF = "/root/testdata/sf0.001"


def test_contained_pairs_equal_a_loop(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    documents = []
    for i in range(150):
        pool = words[: draw.choice([6, 14, 30])]
        documents.append((i, draw.sample(pool, draw.randint(0, len(pool)))))
    items = []
    for i in range(40):
        pool = words[: draw.choice([6, 14, 30])]
        items.append((i, draw.sample(pool, draw.randint(0, len(pool)))))
    want = {(d, b): round(len({*x} & {*y}) / min(len(x), len(y)), 6) for d, x in documents for b, y in items if x and y and 100 * len({*x} & {*y}) >= 92 * min(len(x), len(y))}
    documents += [(900, None), (None, words)]
    got = contained_pairs(spark.createDataFrame(documents, "doc_id int, toks array<string>"), spark.createDataFrame(items + [(901, None)], "item_id int, toks array<string>")).collect()
    assert {(r.doc_id, r.item_id): round(r.containment, 6) for r in got} == want and len(got) == len(want) and len(want) > 50


def test_carriers_equal_a_loop(spark):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("ab. Ä-") for _ in range(n))
    texts = [text(draw.randint(0, 40)) for _ in range(300)] + [None]
    quotes = sorted({text(draw.randint(0, 7)).lower() for _ in range(60)} | {"", "no such thing here"})
    want = {q: n for q in quotes if (n := sum(t is not None and q in t.lower() for t in texts))}
    got = carriers(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(q,) for q in [*quotes, None]], "quote string")).collect()
    assert {r.quote: r.n for r in got} == want and "" in want and len(want) > 10


def test_best_products_equal_a_loop(spark):
    draw = np.random.default_rng(6)
    rows = [(i, int(i % 3), [float(x) for x in np.round(draw.normal(size=4), 1)]) for i in range(200)]
    rows += [(i, 1, [1.0, 0.5, 0.0, 0.0]) for i in range(300, 350)] + [(400, None, [1.0, 1.0, 1.0, 1.0]), (401, 1, None), (402, 2, [1.0, None, 1.0, 1.0]), (403, 2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, label int, vector array<float>")
    found = df.filter("id % 50 = 0 or id = 403")
    for most, least, apart in ((7, None, False), (5, 0.2, True)):
        want = {}
        values = {r.id: (r.label, r.vector) for r in df.collect() if r.vector and None not in r.vector}
        for q in values:
            if q % 50 and q != 403:
                continue
            mine = []
            for o, (label, v) in values.items():
                if o == q or len(v) != len(values[q][1]) or (apart and (label is None or values[q][0] is None or label == values[q][0])):
                    continue
                s = 0.0
                for x, y in zip(v, values[q][1]):
                    s += x * y
                if least is None or s >= least:
                    mine.append((-round(s, 6), o))
            want[q] = [o for _, o in sorted(mine)[:most]]
        got = {}
        for r in best_products(df, found, most, least, apart).orderBy("q", "place").collect():
            got.setdefault(r.q, []).append(r.other)
        assert got == {q: v for q, v in want.items() if v}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_of_rows_is_formed(spark):
    """Before, every token of every item met every document's, every quote every text and every vector every other."""
    assert "NestedLoopJoin" not in plan(neighbourhood(spark, SF))
    assert "zip_with" not in plan(neighbourhood(spark, SF))
    sought = quote_grounding(spark, SF)
    assert "BroadcastHashJoin" in plan(sought)
    quotes = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.regexp_count(F.lower("text"), F.lit("(?<=[^a-zà-ÿ0-9])[a-zà-ÿ0-9]+(?=[^a-zà-ÿ0-9])")).alias("n"))
    assert quotes.filter("n = 0").count() == 0
    assert "count(1)" not in plan(jaccard_brief(spark, SF))
