"""Steps of the collocations hold no more rows than there are candidates, and few where few can be among the best."""

import random

from test_phrases import plainly

from emberline.llm import phrases


def test_few_rows_after_the_bounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choice("abcdefg") for _ in range(400))) for _ in range(40)] + [("en", f"p{i} q{i} r{i}. " * 12) for i in range(20)]
    sizes = {}

    def counted(df, name, plain=phrases.written):
        out = plain(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(phrases, "written", counted)
    got = {tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), keep=10).collect()}
    assert got == plainly(rows, keep=10)
    assert max(n for name, n in sizes.items() if name != "phrases") <= sizes["phrases"]
    assert sizes["cuts"] <= 20
