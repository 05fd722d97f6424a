"""Transport streams: exact round trips, lost and repeated packets, digests against the standard library."""

import hashlib
import random
import zlib

import pytest

from emberline.llm.mpegts import PACKET, demux, from_media, mux, pad, store_and_probe, to_media


def test_round_trip():
    r = random.Random(5)
    for n in [0, 1, 575, 576, 577, 57_600, 57_601, 200_000] + [r.randint(0, 3000) for _ in range(100)]:
        payload = pad(r.randbytes(n))
        stream = demux(mux(payload))
        assert stream.payload == payload and payload and len(payload) % 576 == 0
        assert (stream.lost, stream.repeated, stream.damaged) == (0, 0, 0)
        units = -(-len(payload) // 57_600)
        assert stream.stamps == [3600 * i for i in range(units)] and stream.random_access == list(range(units))


def test_lost_and_repeated_packets_are_counted():
    payload = random.Random(6).randbytes(576 * 250)  # three units of up to 57,600 bytes
    media = mux(payload)
    packets = [media[i : i + PACKET] for i in range(0, len(media), PACKET)]
    starts = [i for i, p in enumerate(packets) if i > 1 and p[1] & 0x40]
    assert len(starts) == 3
    inside = starts[1] + 5
    lost = demux(b"".join(packets[:inside] + packets[inside + 1 :]))
    assert (lost.lost, lost.repeated, lost.damaged) == (1, 0, 1) and lost.stamps == [0, 7200]
    assert lost.payload == payload[:57_600] + payload[2 * 57_600 :]
    twice = demux(b"".join(packets[: inside + 1] + packets[inside:]))
    assert (twice.lost, twice.repeated, twice.damaged) == (0, 1, 0) and twice.payload == payload
    whole = demux(b"".join(packets[: starts[1]] + packets[starts[2] :]))
    assert whole.stamps == [0, 7200] and whole.damaged == 0
    with pytest.raises(ValueError, match="sync"):
        demux(media[:PACKET] + b"\0" + media[PACKET + 1 :])
    with pytest.raises(ValueError, match="checksum"):
        demux(media[:20] + b"\x55" + media[21:])


def test_digests_equal_the_standard_library(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "\u00e9" * 700), (6, "word " * 30_000)]
    frame = spark.createDataFrame([(k, t, b"x", 1) for k, t in rows], "doc_id long, text string, media binary, n_bytes int")
    got = sorted((str(x.doc_id), x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in store_and_probe(frame).collect())
    want = []
    for k, t in rows:
        data = (t or "").encode()
        padded = data + b"\xff" * (576 if not data else -len(data) % 576)
        want.append((str(k), len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    assert got == sorted(want)
    assert len({x.media_sha256 for x in store_and_probe(frame.filter("doc_id = 3")).collect()}) == 1
    assert store_and_probe(frame.limit(0)).count() == 0


def test_media_columns(spark):
    frame = spark.createDataFrame([(1, b"x" * 60_000), (2, None), (3, b"")], "id int, payload binary")
    media = to_media(frame).select("id", "media")
    found = {x.id: x for x in from_media(media).collect()}
    assert bytes(found[1].payload) == b"x" * 60_000 and found[1].pts == [0, 3600] and found[1].random_access == [0, 1]
    assert found[2].payload is None and found[2].pts is None and bytes(found[3].payload) == b""
