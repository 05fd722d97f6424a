"""MPEG transport streams as a media column.

A payload becomes one elementary stream of private data: the payload is cut into access units, each
access unit is a PES packet with a time stamp and starts at a random-access point, PES packets are
cut into 188-byte transport packets with continuity counters, and program tables come first.  The
parser trusts nothing but the bytes: it finds the program map through the association table, checks
section checksums and continuity counters, reassembles the elementary packets and lists their time
stamps with the random-access flags.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, written

#: Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, STREAM_PRIVATE_PES, STREAM_ID_PRIVATE_1 = 188, 0x47, 0x0000, 0x06, 0xBD
#: Our own choices: identifiers, payload bytes per access unit, and 90 kHz ticks between access units.
PMT_PID, DATA_PID, PROGRAM, UNIT_BYTES, TICKS = 0x0100, 0x0101, 1, 57_600, 3600
ALIGN, PADDING = 576, b"\xff"
PROBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        n <<= 24
        for _ in range(8):
            n = (n << 1) ^ (0x04C11DB7 if n & 0x80000000 else 0)
        table.append(n & 0xFFFFFFFF)
    return table


CRC_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(crc >> 24) ^ b]
    return crc


def section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, table: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + table).ljust(PACKET, b"\xff")


PROGRAM_TABLES = table_packet(PAT_PID, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of ALIGN."""
    return data + PADDING * (ALIGN - len(data) if not data else -len(data) % ALIGN)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload in PES packets with time stamps."""
    out, counter = [PROGRAM_TABLES], 0
    for number, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit, pts = payload[start : start + UNIT_BYTES], number * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID_PRIVATE_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + unit
        # First packet: an adaptation field with the random-access flag and the program clock.
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        first, rest = pes[:176], pes[176:]
        stuffing = 176 - len(first)
        out.append(bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | counter, 7 + stuffing, 0x50]) + clock + b"\xff" * stuffing + first)
        whole, tail = divmod(len(rest), 184)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, :3] = (SYNC, DATA_PID >> 8, DATA_PID & 0xFF)
            packets[:, 3] = 0x10 | counter + 1 + np.arange(whole) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
            out.append(packets.tobytes())
        if tail:
            fill = 183 - tail
            field_ = bytes([fill]) + (b"\x00" + b"\xff" * (fill - 1) if fill else b"")
            out.append(bytes([SYNC]) + DATA_PID.to_bytes(2, "big") + bytes([0x30 | counter + 1 + whole & 15]) + field_ + rest[184 * whole :])
        counter = counter + 1 + whole + bool(tail) & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    program: int = -1
    pid: int = -1
    packets: int = 0
    lost: int = 0
    repeated: int = 0
    damaged: int = 0
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)


def parse_table(packet: bytes) -> bytes:
    """The body of the section that starts in this packet, after its checksum has been checked."""
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    at += 1 + packet[at]
    size = 3 + ((packet[at + 1] & 0x0F) << 8 | packet[at + 2])
    whole = packet[at : at + size]
    if crc32_mpeg(whole):
        raise ValueError("program table with a wrong checksum")
    return whole[8:-4]


def demux(media: bytes) -> Stream:
    """Parse a transport stream; raises on lost sync or damaged tables.

    A packet may be sent twice in a row: the repetition is counted and left out.  Gaps of the continuity
    counter are counted as lost; an elementary packet that misses bytes is counted as damaged, and
    neither its bytes nor its stamp are listed.
    """
    if len(media) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    starts, found = packets[:, 1] & 0x40 != 0, Stream(packets=len(packets))
    for at in np.flatnonzero((pids == PAT_PID) & starts):
        body = parse_table(packets[at].tobytes())
        found.program, map_pid = int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big") & 0x1FFF
        for other in np.flatnonzero((pids == map_pid) & starts):
            body = parse_table(packets[other].tobytes())
            skip = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            found.pid = int.from_bytes(body[skip + 1 : skip + 3], "big") & 0x1FFF
    own, start = packets[pids == found.pid], starts[pids == found.pid]
    if len(own) > 1:
        again = np.concatenate(([False], (own[1:] == own[:-1]).all(axis=1) & (own[1:, 3] & 0x10 != 0)))
        again[1:] &= ~again[:-1]
        found.repeated = int(again.sum())
        own, start = own[~again], start[~again]
    control = own[:, 3]
    has_payload = control & 0x10 != 0
    counters = (control & 15).astype(np.int16)
    found.lost = int(np.count_nonzero((counters[1:] - counters[:-1]) % 16 != has_payload[1:]))
    begins = 4 + np.where(control & 0x20, 1 + own[:, 4].astype(np.int32), 0)
    flags = np.where((control & 0x20 != 0) & (own[:, 4] > 0), own[:, 5], 0)
    bounds, units = [*np.flatnonzero(start), len(own)], []
    for first, stop in zip(bounds, bounds[1:], strict=False):
        simple = begins[first:stop] == 4
        parts, k = [], first
        while k < stop:
            if simple[k - first]:
                run = k + int(np.argmin(simple[k - first :])) if not simple[k - first :].all() else stop
                parts.append(own[k:run, 4:].tobytes())
                k = run
            else:
                parts.append(own[k, begins[k] :].tobytes())
                k += 1
        pes = b"".join(parts)
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) != size + 6:
            found.damaged += 1
            continue
        p = pes[9:14]
        pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        if flags[first] & 0x40:
            found.random_access.append(len(found.stamps))
        found.stamps.append(pts)
        units.append(pes[9 + pes[8] :])
    found.payload = b"".join(units)
    return found


def describe(stream: Stream) -> str:
    """Time stamps and random-access points in short, with the spread of the payload's samples."""
    samples = np.frombuffer(stream.payload, np.uint8)
    mean = samples.mean() if len(samples) else 0.0
    first, last = (stream.stamps[0], stream.stamps[-1]) if stream.stamps else (-1, -1)
    return f"program={stream.program};pid={stream.pid};packets={stream.packets};lost={stream.lost};repeated={stream.repeated};damaged={stream.damaged};units={len(stream.stamps)};pts={first}-{last};random_access={len(stream.random_access)};mean={mean:.4f}"


def to_media(df: DataFrame, payload: str = "payload", out: str = "media") -> DataFrame:
    """Add the transport stream of a binary column; null stays null, empty payloads give tables only."""

    @F.pandas_udf("binary")
    def muxed(values):
        return values.map(lambda v: None if v is None else mux(bytes(v)))

    return df.withColumn(out, muxed(F.col(payload)))


PARSED = "payload binary, program int, pid int, packets int, lost int, repeated int, damaged int, pts array<long>, random_access array<int>"


def from_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Add what demux reads from a transport-stream column: payload, losses, time stamps, random-access points (null stays null)."""

    @F.pandas_udf(PARSED)
    def parsed(values):
        import pandas as pd

        found = [None if v is None else demux(bytes(v)) for v in values]
        rows = [[None] * 9 if s is None else [s.payload, s.program, s.pid, s.packets, s.lost, s.repeated, s.damaged, s.stamps, s.random_access] for s in found]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return df.withColumn("_stream", parsed(F.col(media))).select("*", "_stream.*").drop("_stream")


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a transport stream, padded as pad does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1)):
            data = [(value.as_py() or "").encode() for value in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, data), pa.int64()), pa.array([mux(pad(d)) for d in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def probe(stored: DataFrame) -> DataFrame:
    """Digests and features of the media column of store, parsed from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 2)):
            rows = []
            for value in part.column(2):
                media = value.as_py()
                stream = demux(media)
                payload = stream.payload
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(stream)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in PROBED.split(", ")])

    return stored.mapInArrow(lean(run), PROBED)


def store_and_probe(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each whole text as a transport stream in a table, read the stored bytes back, and describe them.

    Null texts count as empty, a null key stays null, repeated rows give repeated results, other
    columns are ignored, an empty table gives no rows.  A task holds one slice of bounded bytes, or
    one text where it is longer than that.
    """
    return probe(written(store(df, key, text), "media", compression="zstd"))
