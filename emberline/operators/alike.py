"""Pairs of token sets of one block or of two: postings of rare tokens are met and counted as arrays, then whole sets are compared."""

from __future__ import annotations

import numpy as np

#: Bits of a token's key that hold how frequent it is; the others are of its hash.
WEIGHT = 6
#: Shared first tokens that are counted, rows that are counted at a time and sets whose tokens are marked at a time (bits of a number).
SHARED, CHUNK, MARKS = 4, 1 << 20, 64


def keys_of(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Numbers that stand for tokens, rare ones first; a sketch has the logarithm of how many tokens there are with the same last bits."""
    bits = hashes.view(np.uint64)
    return (sketch[bits & np.uint64(len(sketch) - 1)].astype(np.uint64) << np.uint64(64 - WEIGHT)) | (bits >> np.uint64(WEIGHT))


class Block:
    """Sets by size: the tokens of all of them (rare ones first) with the sets that hold each, and the tokens of each set in the same order."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray, counts: np.ndarray, holders: np.ndarray):
        self.sizes, self.tokens, self.holders = sizes.astype(np.int64), tokens, holders
        self.starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        # Holders are small numbers, for which a stable sort is by their bits.
        self.codes = np.repeat(np.arange(len(tokens), dtype=np.int32), counts)[np.argsort(holders, kind="stable")]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    @classmethod
    def of(cls, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, counts, holders) of sets given by their sizes and the keys of one after the other."""
        order = np.argsort(keys, kind="stable")
        held = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.uint32), sizes)[order]
        tokens, counts = np.unique(keys[order], return_counts=True)
        return tokens, counts.astype(np.int32), held


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + counts[i] - 1 for each i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def needed(n: np.ndarray, jaccard: int, containment: int) -> np.ndarray:
    """The least number of tokens that a set of n tokens shares with one that is alike and no smaller."""
    by_jaccard = -(-2 * jaccard * n // (100 + jaccard))
    return np.maximum(1, np.minimum(by_jaccard, -(-containment * n // 100)))


def alike_sets(small: Block, large: Block, same: bool, strict: bool, jaccard: int, containment: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the sets of one block that are alike to one of another block (or of the same) that has more tokens, or, unless `strict`, as many.

    A set lacks few of its tokens in one that it is alike to, so it shares some of its first tokens.
    """
    n, m = small.sizes, large.sizes
    if not len(n) or not len(m) or n[0] > m[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if same:
        to = np.arange(len(small.tokens))
    else:
        to = np.searchsorted(large.tokens, small.tokens)
        to[to == len(large.tokens)] = 0
        to = np.where(large.tokens[to] == small.tokens, to, -1) if len(large.tokens) else np.full(len(to), -1)
    need = needed(n, jaccard, containment)
    shared = np.minimum(SHARED, need)
    first = _ranges(small.offsets[:-1], np.minimum(n - need + shared, n))
    who = np.repeat(np.arange(len(n)), np.minimum(n - need + shared, n))
    codes = to[small.codes[first]]
    who, codes = who[codes >= 0], codes[codes >= 0]
    # Sets of one token are in order of size, so those that are large enough come last.
    least = np.arange(len(n)) + 1 if same else np.searchsorted(m, n, "right" if strict else "left")
    many = large.starts[codes + 1] - large.starts[codes]
    upto = np.concatenate([[0], np.cumsum(np.bincount(who, many, len(n)).astype(np.int64))])
    ends = np.searchsorted(who, np.arange(len(n) + 1))
    found_a, found_b, at = [], [], 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK, "right")) - 1)
        part = slice(ends[at], ends[stop])
        a = np.repeat((who[part] - at).astype(np.int32), many[part])
        b = large.holders[_ranges(large.starts[codes[part]], many[part])].astype(np.int32)
        kept = b >= least[at:stop].astype(np.int32)[a]
        key = np.sort(a[kept].astype(np.int64) * len(m) + b[kept])
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, count = key[edge], np.diff(np.append(edge, len(key)))
        a, b = key // len(m) + at, key % len(m)
        enough = count >= shared[a]
        found_a.append(a[enough])
        found_b.append(b[enough])
        at = stop
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    both = _common(small, large, to, a, b)
    alike = (both * 100 >= (n[a] + m[b] - both) * jaccard) | (both * 100 >= n[a] * containment)
    return a[alike], b[alike]


def _common(small: Block, large: Block, to: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens of each set a of the small block are in set b of the large one."""
    order = np.argsort(b, kind="stable")
    sets, starts = np.unique(b[order], return_index=True)
    starts = np.append(starts, len(order))
    both = np.zeros(len(a), np.int64)
    marks = np.zeros(len(large.tokens) + 1, np.uint64)  # the last one is for tokens that the large block lacks
    for at in range(0, len(sets), MARKS):
        here = sets[at : at + MARKS]
        for bit, s in enumerate(here):
            marks[large.codes[large.offsets[s] : large.offsets[s + 1]]] |= np.uint64(1 << bit)
        pairs = order[starts[at] : starts[at + len(here)]]
        bits = np.repeat(np.arange(len(here), dtype=np.uint64), np.diff(starts[at : at + len(here) + 1]))
        sizes = small.sizes[a[pairs]]
        upto, k = np.cumsum(sizes), 0
        while k < len(pairs):
            stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + CHUNK, "right")))
            some, length = pairs[k:stop], sizes[k:stop]
            held = marks[to[small.codes[_ranges(small.offsets[a[some]], length)]]] >> np.repeat(bits[k:stop], length) & np.uint64(1)
            both[some] = np.add.reduceat(held, np.concatenate([[0], np.cumsum(length)[:-1]])) if len(held) else 0
            k = stop
        for s in here:
            marks[large.codes[large.offsets[s] : large.offsets[s + 1]]] = 0
    return both
