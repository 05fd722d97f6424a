"""Cost-balanced packing of token ids into sequences of fixed capacity.

Each task packs its own rows in blocks of bounded size: documents longer than a sequence are cut to
full pieces, what is left is taken in descending length, and each piece goes to the sequence of
lowest cost that still has room, where cost is linear in the tokens plus quadratic in each piece
(attention does not cross pieces).  A piece that fits nowhere is cut over the cheapest sequences.
A block fills whole sequences only; the remainder moves on to the next block, and a task's last
remainder goes to sequences whose lengths are powers of two, so there is no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, gathered, lean, slices

#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Chunks that a worker remembers in each of two generations; bounds memory, never results.
MAX_REMEMBERED = 100_000
#: Characters of new chunks that one tokenizer call takes.
CALL_CHARS = 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Marks that may compose with a Latin letter, and what special tokens begin with: such texts are not lowered here.
NOT_LOWERED = "[\u0300-\u036f]|<\\|"
STOPS, SEPARATOR = frozenset(".,"), "|"
#: Below this, every letter stays one letter when it is normalised and lowered.
FIRST_UNSURE = "\u0130"


class WordEncoder:
    """Token ids by a lower-casing `tokenizers` word file, as little-endian 32-bit numbers.

    Its pre-tokenizer drops white space and never joins characters across it, so a text's ids are the
    ids of its chunks between blanks and line ends, and chunks repeat: each distinct one of a slice of
    texts is looked up once.  A stop or comma after simple letters is a token of its own.  A chunk of
    letters is one word, which ends with the first token that carries the word-end mark; other chunks
    are told apart by a separator that none of them holds.  So new chunks are encoded many at a time.
    """

    def __init__(self, path: str, remembered: int = MAX_REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.separator = self._ids(SEPARATOR)
        self.stops = {stop: self._ids(stop).tobytes() for stop in STOPS}
        self.known = Remembered(self._learn, remembered)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, chunks: list[str], glue: str) -> list[bytes]:
        """Ids of each chunk, from one call for all of them where these can be told apart."""
        ids = self._ids(glue.join(chunks))
        if glue == " ":
            stops = np.flatnonzero(self.ends[ids]) + 1
            starts = np.concatenate(([0], stops[:-1]))
        else:
            at = np.flatnonzero(ids == self.separator[0])
            starts, stops = np.concatenate(([0], at + 1)), np.append(at, len(ids))
        if len(stops) != len(chunks):
            return [self._ids(c).tobytes() for c in chunks]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * stops).tolist(), strict=True)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        words, stopped, rest, alone = {}, [], [], []
        for chunk in chunks:
            word = chunk[:-1] if chunk[-1:] in STOPS else chunk
            if word.isalpha() and (word.isascii() or max(word) < FIRST_UNSURE):
                words[word] = None
                if word != chunk:
                    stopped.append(chunk)
            else:
                (alone if SEPARATOR in chunk or len(self.separator) != 1 else rest).append(chunk)
        found = {chunk: self._ids(chunk).tobytes() for chunk in alone}
        for group, glue in ((list(words), " "), (rest, f" {SEPARATOR} ")):
            size = np.cumsum([len(c) for c in group])
            at = 0
            while at < len(group):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CALL_CHARS, side="right")))
                found.update(zip(group[at:to], self._together(group[at:to], glue), strict=True))
                at = to
        for chunk in stopped:
            found[chunk] = found[chunk[:-1]] + self.stops[chunk[-1]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in a row, and the number of each text's ids."""
        lowered = pc.if_else(pc.match_substring_regex(texts, NOT_LOWERED), texts, pc.ascii_lower(texts))
        lists = pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        values = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self.known.values(values)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        codes = chunks.indices.to_numpy()
        each = sizes[codes]
        stops = np.cumsum(each)
        out = flat[np.repeat(starts[codes] - stops + each, each) + np.arange(stops[-1] if len(stops) else 0)]
        ends = np.concatenate(([0], stops))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return out, np.diff(ends)

    def encode_text(self, text: str) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()))[0]


@functools.lru_cache(maxsize=1)
def word_encoder(path: str, remembered: int = MAX_REMEMBERED) -> WordEncoder:
    return WordEncoder(path, remembered)


def capacities(tokens: int, capacity: int, last: bool) -> list[int]:
    """Lengths of the sequences to fill: whole ones and, at the end, powers of two for the rest."""
    rest = tokens % capacity if last else 0
    return [capacity] * (tokens // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(pieces: list[tuple[int, int, int]], room: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Place (document, start, length) pieces in sequences with this room.

    Gives (sequence, offset, document, start, length) and what is left when all sequences are full.
    """
    placed, left = [], []
    limit = np.array(room, np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    for document, start, length in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while length:
            free = limit - used
            fits = np.flatnonzero(free >= length)
            if not len(fits):
                fits = np.flatnonzero(free)
                if not len(fits):
                    left.append((document, start, length))
                    break
            at = int(fits[np.argmin(cost[fits])])
            part = min(length, int(free[at]))
            placed.append((at, int(used[at]), document, start, part))
            used[at] += part
            cost[at] += LINEAR * part + QUADRATIC * part * part
            start, length = start + part, length - part
    return placed, left


def pack(df: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, block_tokens: int = 1_000_000, remembered: int = MAX_REMEMBERED, key: str = "doc_id", text: str = "text", forget: bool = False, slice_bytes: int = 4 << 20) -> DataFrame:
    """Pack every row's ids (its text's, then end_id) into sequences; one output row per piece.

    Null texts count as empty (end_id only), null keys stay null, repeated rows are packed each on
    its own, other columns are ignored, an empty table gives no rows.  A sequence never spans tasks;
    its id holds the partition in the upper 32 bits and a running number below.  Texts are taken in
    slices of slice_bytes (smaller ones take less memory and more time), so a task holds one slice, one block and the longest text; remembered bounds
    the chunks that a worker process keeps between tasks, and with forget it keeps none, nor the
    vocabulary, which suits a session whose workers have other work to do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = word_encoder(path, remembered), TaskContext.get().partitionId() << 32
        held: dict[int, tuple[object, np.ndarray]] = {}
        pieces: list[tuple[int, int, int]] = []
        tokens = number = done = 0

        def flush(last: bool):
            nonlocal pieces, tokens, done
            room = capacities(tokens, capacity, last)
            whole, rest = [], []
            for document, start, length in pieces:
                for at in range(start, start + length, capacity):
                    (rest if start + length - at < capacity else whole).append((document, at, min(capacity, start + length - at)))
            full = whole[: room.count(capacity)]
            placed = [(n, 0, *p) for n, p in enumerate(full)]
            more, left = assign(whole[len(full) :] + rest, room[len(full) :])
            placed += [(n + len(full), *p) for n, *p in more]
            ids = {d for _, _, d, _, _ in placed}
            rows = [(held[d][0], s, n, zlib.crc32(held[d][1][s : s + n].tobytes()), len(held[d][1]), base + done + q, o) for q, o, d, s, n in placed]
            done += len(room)
            pieces, tokens = left, sum(p[2] for p in left)
            for d in ids - {p[0] for p in left}:
                del held[d]
            types = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in gathered(batches, 1, slice_bytes):
            for part in slices(batch, 1, slice_bytes):
                ids, sizes = encoder.encode(pc.fill_null(part.column(1), ""))
                for doc_id, own in zip(part.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    own = np.append(own, np.uint32(end_id)).astype("<u4", copy=False)
                    held[number] = (doc_id, own)
                    pieces.append((number, 0, len(own)))
                    tokens += len(own)
                    number += 1
                    if tokens >= block_tokens:
                        yield flush(False)
        if pieces:
            yield flush(True)
        if forget:
            del encoder
            word_encoder.cache_clear()

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), SCHEMA)
