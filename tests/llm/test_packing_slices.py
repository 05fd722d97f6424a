"""Small slices and a short memory change no piece."""

import public_tokenizers

from emberline.llm.packing import pack


def test_slices_change_nothing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, None if i % 9 == 4 else f"Some words, number {i} and {i * i}. " * (i % 40)) for i in range(120)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, pack(docs, path, block_tokens=5_000).collect()))
    assert sorted(map(tuple, pack(docs, path, block_tokens=5_000, remembered=20, forget=True, slice_bytes=500).collect())) == want
