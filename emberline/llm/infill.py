"""Fill-in-middle: texts cut at two token boundaries and put together again with their middle last.

Boundaries are found with big integers that hold one bit a byte: `bytes.translate` makes the masks of
the byte classes, shifted boolean operations mark where tokens begin, `bit_count` gives their number,
and halving an integer again and again leads to the bit of a given rank.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = bytes(b"01"[c in _SPACES] for c in range(256))
#: Every byte of UTF-8 but 10xxxxxx begins a code point.
_BEGINS = bytes(b"10"[c >> 6 == 0b10] for c in range(256))


def starts(data: bytes) -> int:
    """A bit for each byte, the first byte highest: set where a token `[spaces]*[others]+|[spaces]+` begins."""
    if not data:
        return 0
    space = int(data.translate(_IS_SPACE), 2)
    return space & ~(space >> 1) | 1 << len(data) - 1


def place(bits: int, length: int, rank: int) -> int:
    """The place, from the highest of `length` bits, of the set bit with this rank (from 0); `length` if there is none.

    Each step counts one half and goes on in the half that holds the bit, so all steps together are linear.
    """
    if rank >= bits.bit_count():
        return length
    at = 0
    while length > 1:
        low = length >> 1
        high = bits >> low
        above = high.bit_count()
        if rank < above:
            bits, length = high, length - low
        else:
            bits, rank, at, length = bits ^ high << low, rank - above, at + length - low, low
    return at


def cut(data: bytes, first: int, second: int) -> tuple[int, int, int]:
    """(tokens, code points of the prefix, code points of the middle) for two draws, taken modulo tokens + 1."""
    bits = starts(data)
    tokens = bits.bit_count()
    lower, upper = sorted((first % (tokens + 1), second % (tokens + 1)))
    a, b = place(bits, len(data), lower), place(bits, len(data), upper)
    points = int(data.translate(_BEGINS), 2) if data else 0
    before, through = ((points >> len(data) - x).bit_count() for x in (a, b))
    return tokens, before, through - before


_FIELDS = ("n", "prefix", "middle")


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in _FIELDS]))
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    data = text.cast(pa.binary())
    rows = [cut(d.as_py(), a, b) for d, a, b in zip(data, first.to_pylist(), second.to_pylist())]
    columns = zip(*rows) if rows else [()] * len(_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], _FIELDS)


def _draw(doc_id: Column, seed: int, group: int) -> Column:
    """An 8-digit group of the hexadecimal sha256 of seed:id, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs (doc_id, text).

    `rate` per cent of the texts are cut, `spm_rate` per cent of those with the suffix first; all draws
    come from the seed and the id, so equal rows give equal results.  A null text counts as empty, a
    null id as the empty text; empty texts and texts that hold a mark stay plain, with null lengths.
    Very long texts are cut whole, one at a time.  Repeated rows give repeated results, an empty table
    none; other columns are ignored.
    """
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    draws = [_draw(F.col("doc_id"), seed, group) for group in (1, 2, 3, 4)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (draws[2] % 100 >= rate)
    form = F.when(plain, "plain").when(draws[3] % 100 < spm_rate, "spm").otherwise("psm")
    found = held.select("doc_id", "text", form.alias("form"), _cuts("text", draws[0], draws[1]).alias("_cut"))
    before, middle = F.col("_cut.prefix").cast("int"), F.col("_cut.middle").cast("int")
    parts = {
        PREFIX: F.substring("text", F.lit(1), before),
        MIDDLE: F.substring("text", before + 1, middle),
        SUFFIX: F.substring("text", before + middle + 1, F.length("text")),
    }
    orders = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
    output = F.col("text")
    for name, order in orders.items():
        output = F.when(F.col("form") == name, F.concat(*[x for mark in order for x in (F.lit(mark), parts[mark])])).otherwise(output)
    kept = F.col("form") != "plain"
    return found.select(
        "doc_id",
        F.col("_cut.n").alias("n"),
        "form",
        F.when(kept, F.col("_cut.prefix")).alias("prefix_chars"),
        F.when(kept, F.col("_cut.middle")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A cut text holds no mark and no mark overlaps itself, so each mark stands exactly once in its output.
    """
    before_middle, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def between(first: str, then: str) -> tuple[Column, Column]:
        rest = F.substring(before_middle, F.lit(len(first) + 1), F.length(output))
        return F.substring_index(rest, then, 1), F.substring_index(rest, then, -1)

    prefix, suffix = between(PREFIX, SUFFIX)
    late_suffix, late_prefix = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, middle, late_suffix)).otherwise(output)
