"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Every piece of the split pattern is encoded apart.  A piece's bytes become a Latin-1 string, in
which an Aho-Corasick automaton finds every vocabulary token in one pass; from these matches the
longest token at each position follows.  The encoder walks left to right with the longest token and
steps back to shorter prefixes whenever two neighbours could not have come out of the merge order.
Whether two tokens may stand side by side is decided by undoing merges and is memoised, and
positions that lead nowhere are marked, so each position is given up at most once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Pieces remembered by a worker before it starts anew; bounds memory, never results.
MAX_REMEMBERED = 700_000
TOUCHING_SPACE = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Remembered(dict):
    """A dictionary that computes what it lacks and empties itself when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        self[key] = value
        return value


class BacktrackingEncoder:
    """Exact BPE for one rank file; built once per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.ranks = ranks
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or self._undo(token, rank):
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if self._usable(token[:n])), None)
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.remembered = Remembered(lambda piece: self.encode_piece(piece.encode()))
        self.spaced = Remembered(lambda chunk: self._pieces(chunk if chunk[:1] == "\n" else " " + chunk))

    def _usable(self, token: bytes) -> bool:
        return token in self.ranks and (len(token) == 1 or self.ranks[token] in self.halves)

    def _undo(self, token: bytes, rank: int) -> bool:
        """Replay the merges below this rank; the token is reachable if exactly two parts are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        left, right = (self.ranks.get(p) for p in parts)
        if left is None or right is None:
            return False
        self.halves[rank] = (left, right)
        self.merged[left, right] = rank
        return True

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merge order can leave these two tokens next to each other.

        Undo the later merge of the two again and again; if the touching parts would have been
        merged before the merge that is undone, the pair cannot occur.
        """
        limit = float("inf")
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                parts = self.halves.get(left)
                if parts:
                    limit, left = left, parts[1]
                    continue
                parts = self.halves.get(right)
                if not parts:
                    return True
                limit, right = right + 1, parts[0]
            else:
                parts = self.halves.get(right)
                if parts:
                    limit, right = right + 1, parts[0]
                    continue
                parts = self.halves.get(left)
                if not parts:
                    return True
                limit, left = left, parts[1]

    def fits(self, left: int, right: int) -> bool:
        if len(self.allowed) >= MAX_REMEMBERED:
            self.allowed.clear()
        self.allowed[left, right] = answer = self._fits(left, right)
        return answer

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size = len(piece)
        longest = [-1] * size
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length] = rank  # ends ascend, so the last one for a start is the longest
        dead = bytearray(size + 1)
        out: list[int] = []
        at, last, token, sizes, allowed = 0, -1, longest[0], self.sizes, self.allowed
        while True:
            end = at + sizes[token]
            if not dead[end]:
                fits = True if last < 0 else allowed.get((last, token))
                if fits is None:
                    fits = self.fits(last, token)
                if fits:
                    out.append(token)
                    if end == size:
                        return tuple(out)
                    at, last, token = end, token, longest[end]
                    continue
            shorter = self.shorter[token]
            if shorter is not None:
                token = shorter
                continue
            dead[at] = 1
            token = out.pop()
            at -= sizes[token]
            last = out[-1] if out else -1

    def _pieces(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.remembered.__getitem__, self.split(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text.

        Where no two white-space characters touch, the split pattern always breaks before a space
        and around a line end, so " word" and line-end chunks can be looked up one by one; any
        other text is split as a whole.
        """
        if TOUCHING_SPACE.search(text):
            return list(self._pieces(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        return [*self._pieces(first), *chain.from_iterable(map(self.spaced.__getitem__, rest))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BacktrackingEncoder:
    return BacktrackingEncoder(read_ranks(path), pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of a text column as array<int>.  Null texts give null, empty texts no ids."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        own = encoder(path, pattern)
        return texts.map(lambda t: None if t is None else own.encode(t))

    return df.withColumn(out, ids(F.col(text)))


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an id column stands for.  Null stays null; an id outside the file raises."""

    @F.pandas_udf("binary")
    def decoded(lists):
        own = encoder(path, pattern)
        return lists.map(lambda x: None if x is None else own.decode(list(x)))

    return df.withColumn(out, decoded(F.col(ids)))


def token_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text in one Arrow pass; keep counts and digests only.

    Null texts count as empty: no tokens, the digests of empty strings.  A null key stays null,
    repeated rows give repeated results, other columns are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        number = {rank: str(rank) for rank in own.bytes_of}
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(lean(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
