"""Small brute-force and edge-case tests of the training-data operators."""

import random
from itertools import combinations

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

HARD = [(1, None, "x"), (2, "", "x"), (3, "a b c d", None), (3, "a b c d", "x"), (None, "a b c d", "x"), (5, "Ünï çödé\n\n  two   spaces\t.", "x"), (6, "word " * 30_000, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(HARD, "doc_id long, text string, key string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


def test_bpe_equals_tiktoken():
    import tiktoken

    from emberline.llm.bpe import encoder, read_ranks

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = encoder(path, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x24F), r.randint(0x4E00, 0x4EFF), 10, 32])) for _ in range(r.randint(0, 40)))
        assert own.encode(text) == other.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_every_text_operator_takes_hard_rows(spark, docs, empty):
    from emberline.llm.bpe import token_digests
    from emberline.llm.mpegts import store_and_probe
    from emberline.llm.simhash import near_duplicates

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for run in (store_and_probe, near_duplicates, lambda d: token_digests(d, path, public_tokenizers.PATTERN)):
        assert run(docs).count() == len(HARD)
        assert run(empty).count() == 0


def test_simhash_components_equal_brute_force(spark):
    from emberline.llm.graph import connected_components
    from emberline.llm.simhash import links

    r = random.Random(6)
    points = set()
    for _ in range(60):
        base = r.getrandbits(64)
        points.add(base)
        for _ in range(4):
            base ^= 1 << r.randrange(64) | (1 << r.randrange(64) if r.random() < 0.5 else 0)
            points.add(base)
    points = sorted(p - (1 << 64) if p >> 63 else p for p in points)
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(points, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(links(spark.createDataFrame([(p,) for p in points], "fp long"))).collect()}
    assert {p: got.get(p, p) for p in points} == {p: find(p) for p in points}


def test_warc_round_trip(spark):
    from emberline.llm.warc import archive_round_trip, coalesced

    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "é" * 9), (None, "u", "x")]
    got = archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got.collect()}
    assert found == {1: ("revisit", 2, 1), 2: ("response", None, 1), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 18), None: ("revisit", 2, 1)}
    assert [x[1:3] for x in coalesced([("a", 0, 5), ("a", 5, 5), ("a", 99, 1), ("b", 0, 2)], 10, 100)] == [(0, 10), (99, 100), (0, 2)]


def test_nearest_equals_brute_force_with_copies_and_bad_vectors(spark):
    from emberline.llm.neighbours import nearest

    r = np.random.default_rng(8)
    vectors = r.standard_normal((300, 16)).astype(np.float32)
    vectors[100:180] = vectors[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(350, None), (400, [0.0] * 16), (450, [float("nan")] * 16), (500, [None] * 16)]
    got = {}
    for x in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for q in range(0, 300, 50):
        sims = unit @ unit[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-round(sims[i], 9), i))[:5]
        assert got[q] == want
    assert set(got) == set(range(0, 300, 50))


def test_graph_rounds_go_on_until_few_edges_change(spark):
    """From a poor start, which three rounds do not mend."""
    from emberline.llm.neighbours import build_graph, nodes

    r = np.random.default_rng(10)
    vectors = r.standard_normal((3000, 8))
    points = nodes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>")).cache()
    found = {}
    for x in build_graph(points, k=10, tables=2, block=12).select("v", "u").collect():
        found.setdefault(x.v, set()).add(x.u)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    top = np.argsort(-sims, axis=1)[:, :10]
    assert np.mean([len(found.get(i, set()) & set(t.tolist())) for i, t in enumerate(top)]) >= 9


def test_nearest_tells_near_copies_apart(spark):
    """In a large group the vectors differ by less than signed bytes can tell."""
    from emberline.llm.neighbours import nearest

    r = np.random.default_rng(11)
    base = r.standard_normal(16)
    vectors = base + 0.003 * r.standard_normal((1500, 16))
    got = {}
    for x in nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = [len(got[q] & set(np.argsort(-np.where(np.arange(1500) == q, -2, unit @ unit[q]))[:5].tolist())) for q in range(0, 1500, 50)]
    assert sum(hits) >= 0.95 * 5 * len(hits)


def test_language_and_toxicity_learn_and_take_hard_rows(spark, docs, empty):
    from emberline.llm.language import identify
    from emberline.llm.toxicity import score_toxicity

    r = random.Random(9)
    syllables = {"aa": ["ka", "ti", "mo"], "bb": ["szy", "przy", "wo"]}
    rows = []
    for i in range(300):
        lang = r.choice(["aa", "bb"])
        words = ["".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(40)]
        toxic = int(r.random() < 0.3)
        if toxic:
            words[7], words[21] = "vilex" + r.choice("abc"), "vilex"
        rows.append((i, " ".join(words), lang, toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    found = identify(table.drop("toxic")).collect()
    assert all(x.lang_pred == rows[x.doc_id][2] for x in found)
    scored = score_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).collect()
    held = [x for x in scored if x.held_out]
    assert sum(x.predicted == rows[x.doc_id][3] for x in held) >= 0.95 * len(held)
    labels = table.select("doc_id", "toxic").limit(0)
    assert score_toxicity(docs, labels).count() == len(HARD) and score_toxicity(empty, labels).count() == 0
    plain = docs.withColumnRenamed("key", "lang")
    assert {x.lang_pred for x in identify(plain).filter("text is null or text = ''").collect()} == {"und"}
    assert identify(empty.withColumnRenamed("key", "lang")).count() == 0
