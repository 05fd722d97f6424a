"""Every vector asks for its best answers and neighbours, against all products of the table."""

import numpy as np
import pytest

from emberline.operators import matching
from emberline.operators.texts import answer_search, neighbourhood

SF = "/root/testdata/sf0.001"


def rows_of(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    vectors = np.array([r.embedding for r in rows], np.float64)
    total = np.zeros((len(rows), len(rows)))
    for d in range(vectors.shape[1]):
        total += vectors[:, d][:, None] * vectors[:, d][None, :]
    return rows, total


@pytest.mark.parametrize("block", [2048, 37])
def test_every_vector_has_its_answers(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    monkeypatch.setattr(matching, "PART", 64 << 20 if block > 99 else 100 * 64 * 4)
    rows, total = rows_of(spark)
    want = set()
    for i, a in enumerate(rows):
        best = sorted((-round(total[i, j], 6), b.vec_id) for j, b in enumerate(rows) if b.label != a.label and total[i, j] >= 0.2)
        want |= {(a.vec_id, other) for _, other in best[:5]}
    got = {(r.q, r.answer) for r in answer_search(spark, SF).collect()}
    assert got == want and len({q for q, _ in got}) > len(rows) // 10


def test_every_vector_has_its_neighbourhood(spark):
    rows, total = rows_of(spark)
    want = set()
    for i, a in enumerate(rows):
        best = sorted((-round(total[i, j], 6), b.vec_id, total[i, j]) for j, b in enumerate(rows) if j != i)
        want |= {(a.vec_id, other) for _, other, s in best[:30] if s >= 0.25}
    got = {(r.q, r.other) for r in neighbourhood(spark, SF).collect()}
    assert got == want and len({q for q, _ in got}) > len(rows) // 10
