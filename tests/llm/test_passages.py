"""Repeated passages: planted cases, and links and spans against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("xxhash")


def test_passages_inside_other_text_are_found(spark):
    from emberline.llm.passages import remove_repeats, repeated_passages

    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    passage = words(60)
    rows = [(1, f"{words(100)} {passage} {words(80)}"), (2, f"{words(50)} {passage}\n{words(90)}"), (3, words(300)), (4, None), (5, ""), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_passages(docs).collect()
    assert {(x.doc_id, x.removed, x.component_id) for x in found} == {(1, False, 1), (2, True, 1)}
    kept = {x.doc_id: x.text for x in remove_repeats(docs).collect()}
    assert len(kept) == 6 and kept[1] == rows[0][1] and kept[3] == rows[2][1] and len(kept[2].split()) < 190
    assert repeated_passages(docs.limit(0)).count() == 0


def test_passages_in_short_lines_are_found(spark):
    """Passages of 60 words in lines of so many words, alike in two documents and wrapped anew in a third."""
    from emberline.llm.passages import repeated_passages

    r = random.Random(12)
    words = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    wrapped = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    rows, widths = [], [2, 3, 4, 5, 6, 7, 8, 11] * 12
    for i, width in enumerate(widths):
        passage = words(60)
        rows += [(3 * i + k, "\n".join((wrapped(words(24), width), wrapped(passage, n), wrapped(words(24), width)))) for k, n in enumerate((width, width, width + 9))]
    found = {}
    for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=12).collect():
        if x.doc_id % 3 < 2:
            assert x.removed == (x.doc_id % 3 > 0) and x.component_id == x.doc_id // 3 * 3
        found.setdefault(x.doc_id, set()).update(range(x.start, x.start + x.n_words))
    assert all(v <= set(range(24, 84)) for v in found.values())
    for width in sorted(set(widths)):
        own = [i for i, w in enumerate(widths) if w == width]
        alike, anew = ([len(found.get(3 * i + k, ())) for i in own] for k in (1, 2))
        assert min(alike) >= 50, (width, alike)
        assert min(anew) >= 12 and sum(anew) >= 0.5 * 60 * len(anew), (width, anew)


def least_by_links(n, linked):
    """Each node's least reachable node, by plain union-find."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("block", [7, 2048])
def test_links_of_crowded_buckets_equal_brute_force(spark, block):
    """Families of edited copies, some only linked through bridges, all in the same crowded buckets."""
    from emberline.llm.graph import connected_components
    from emberline.llm.passages import band_buckets, jaccard, paragraph_links

    rng, sets, bands = np.random.default_rng(5), [], []
    for base in np.array_split(rng.permutation(2_000)[:400].astype("<u8"), 4):
        last = base
        for i in range(20):
            changed = (last if i % 3 else base).copy()
            places = rng.choice(100, rng.integers(0, 14), replace=False)
            changed[places] = rng.integers(10_000, 1 << 62, len(places))
            sets.append(np.unique(changed))
            bands.append([1, int(rng.integers(2)), int(rng.integers(3))])
            last = changed
    sets += [np.arange(3, dtype="<u8"), sets[0][:50]]
    bands += [[1, 7, 8], [2, 9, 9]]
    data = [x.tobytes() for x in sets]
    met = [(a, b) for a, b in combinations(range(len(sets)), 2) if any(x == y for x, y in zip(bands[a], bands[b], strict=True))]
    want = least_by_links(len(sets), [(a, b) for a, b in met if jaccard(data[a], data[b]) >= 0.8])
    paragraphs = spark.createDataFrame(list(enumerate(bands)), "key long, bands array<long>")
    shingles = spark.createDataFrame([(k, len(x), d) for k, (x, d) in enumerate(zip(sets, data, strict=True))], "key long, size int, shingles binary")
    links = paragraph_links(paragraphs, band_buckets(paragraphs), shingles, 0.8, block=block)
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert [found.get(k, k) for k in range(len(sets))] == want
    assert 5 < len(set(want)) < 60


def test_near_copies_of_paragraphs_equal_brute_force(spark):
    """Every pair of paragraphs of 20 to 90 words with a Jaccard similarity of 0.8 or more is found, and nothing else."""
    from emberline.llm.passages import repeated_passages

    r = random.Random(21)
    words = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    rows = []
    for i in range(120):
        base = words(r.randint(20, 90))
        for k in range(2):
            copy = list(base)
            if k:
                for _ in range(r.randint(1, 3)):
                    copy[r.choice([0, len(copy) - 1, r.randrange(len(copy))])] = "changed" + str(r.random())
            rows.append((2 * i + k, copy))
    shingled = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, w in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(shingled[::2], shingled[1::2], strict=True)]
    docs = spark.createDataFrame([(k, "\n".join((" ".join(words(30)), " ".join(w), " ".join(words(30))))) for k, w in rows], "doc_id long, text string")
    whole = {(x.doc_id, x.removed, x.component_id) for x in repeated_passages(docs).collect() if x.start <= 30 and x.start + x.n_words >= 30 + len(rows[x.doc_id][1])}
    for i, s in enumerate(alike):
        if s >= 0.8:
            assert {(2 * i, False, 2 * i), (2 * i + 1, True, 2 * i)} <= whole
    assert 20 < sum(s >= 0.8 for s in alike) < 110


def test_hard_rows_and_clashing_names(spark):
    from emberline.llm.passages import remove_repeats, repeated_passages

    passage = " ".join(f"word{i}" for i in range(70))
    rows = [(1, passage, "x"), (2, f"before it\n{passage}\nafter it", "y"), (2, f"before it\n{passage}\nafter it", "y"), (3, passage.upper(), None), (4, None, "z"), (5, "", "z"), (6, " \n ", "z"), (None, passage, "z"), (7, "one " * 30_000, "q")]
    docs = spark.createDataFrame([(k, t, c, c, 1, 2, 3) for k, t, c in rows], "doc_id long, text string, _key string, key string, start int, _spans int, component int")
    assert {(x.doc_id, x.start, x.n_words, x.component_id, x.removed) for x in repeated_passages(docs).collect()} == {(1, 0, 70, 1, False), (2, 2, 70, 1, True), (3, 0, 70, 1, True)}
    kept = remove_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted((str(x.doc_id), x.text) for x in kept.collect()) == sorted((str(k), "before it\nafter it" if k == 2 else t) for k, t, _ in rows if k != 3)
    assert remove_repeats(docs.limit(0)).count() == 0
