"""Token ids against an untouched tokenizer, and sequences against a recount of every id."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "|", " ", "\n", "\t", "  ", ".", ",", "\u0130", "i", "J", "\u030c", "\u0308", "\u00df", "\u03a3", "\u0958", "'s", "'LL", "a", "Zz", "\u00c9", "\u00bd", "\u0663", "\u00a0", "\u2028", "\x1c", "\u01c5", "\ufb01", "\U0001f600", "\u1112", "\u1161", "_", "\u212b"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_chunked_ids_equal_whole_text_ids(whole):
    from emberline.llm.packing import WordEncoder

    own, r = WordEncoder(PATH, remembered=300), random.Random(4)
    letters = lambda: chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0x36F), r.randint(0x370, 0xD7FF), r.randint(0xE000, 0x1FFFF)]))
    texts = ["".join(r.choice(ODD) if r.random() < 0.8 else letters() for _ in range(r.randint(0, 14))) for _ in range(8000)]
    texts += ["\u0130.", "a <|startoftext|> b", "J\u030c.", "", "word, word. (word). word.,"]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        ids, sizes = own.encode(pa.array(part))
        for text, got in zip(part, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)
    assert own.encode_text("\u0130.").tolist() == [328, 136, 229, 269] and own.encode_text("a <|startoftext|> b").tolist() == [320, 49406, 321]


def test_sequences_hold_every_id_once(spark, whole):
    from emberline.llm.packing import capacities, pack

    rows = [(1, None), (2, ""), (3, "a b c d"), (None, "x. y"), (5, "\u00dcn\u00ef \u00e7\u00f6d\u00e9\n\n  two   spaces\t."), (6, "word " * 30_000), (7, "z" * 20_000)] + [(i, f"text {i} of some length " * (i % 40)) for i in range(8, 200)]
    ids = {k: whole.encode(t or "", add_special_tokens=False).ids + [2] for k, t in rows}
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, sequence_id int, length int")
    got, seen, places = pack(frame.repartition(3), PATH, block_tokens=20_000).collect(), {}, {}
    for x in got:
        assert x.doc_tokens == len(ids[x.doc_id])
        assert x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4").tobytes())
        seen.setdefault(x.doc_id, []).append((x.start, x.length))
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert set(seen) == set(ids)
    for parts, size in [(p, len(ids[k])) for k, p in seen.items()] + [(p, None) for p in places.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == size if size else at == 4096 or at & (at - 1) == 0
    assert pack(frame.limit(0), PATH).count() == 0
    twice = pack(spark.createDataFrame([(3, "a b"), (3, "a b")], "doc_id long, text string"), PATH).collect()
    assert sum(x.length for x in twice) == 6
    assert capacities(10_000, 4096, True) == [4096, 4096, 1024, 512, 256, 16]


def test_cost_decides_between_sequences():
    from emberline.llm.packing import assign

    placed, left = assign([(0, 0, 60), (1, 0, 50), (2, 0, 30), (3, 0, 40)], [100, 100])
    assert not left and {d: q for q, _, d, _, _ in placed} == {0: 0, 1: 1, 3: 1, 2: 0}
