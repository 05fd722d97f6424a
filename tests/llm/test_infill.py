"""Fill-in-middle against the token pattern, and back again."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from emberline.llm.infill import cut, fill_in_middle, place, restored, starts

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50, spm_rate=80):
    """The row by the pattern itself."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(tokens), "plain", None, None, text
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < spm_rate else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(tokens), "spm" if h4 % 100 < spm_rate else "psm", len(prefix), len(middle), output


def hard_rows():
    rng = random.Random(7)
    texts = ["", None, " ", "\t\n", "a", " a ", "<P>", "x <S> y", "<M", "<P <S <M < > P>", "é\u2028ß 漢字 😀\x00\x1c b", "word " * 300_000, "x" * 500_000]
    texts += ["".join(rng.choice(" \t\nabé漢😀<PSM>\x0b\x1f") for _ in range(rng.randrange(40))) for _ in range(600)]
    return list(enumerate(texts)) + [(None, "no id here"), (3, "a b c"), (3, "a b c")]


@pytest.mark.parametrize("rate,spm_rate", [(50, 80), (100, 0), (100, 50), (0, 0)])
def test_equals_the_pattern_and_comes_back(spark, rate, spm_rate):
    rows = hard_rows()
    docs = spark.createDataFrame([(i, t, "psm", 9) for i, t in rows], "doc_id bigint, text string, form string, n int")
    got = fill_in_middle(docs, rate=rate, spm_rate=spm_rate).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([plainly(i, t, rate, spm_rate) for i, t in rows], key=key)
    texts = {i: t or "" for i, t in rows if i != 3}
    assert all(r.back == texts[r.doc_id] for r in got if r.doc_id != 3)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_places_of_all_ranks():
    data = b" a  b\tc d " * 50
    at = [m.start() for m in TOKEN.finditer(data.decode())]
    bits = starts(data)
    assert [place(bits, len(data), k) for k in range(len(at) + 2)] == [*at, len(data), len(data)]
    assert starts(b"") == 0 and cut(b"", 5, 6) == (0, 0, 0)
