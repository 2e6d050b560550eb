"""Fill-in-middle: a text becomes prefix, suffix and middle with markers between them, cut where words end.

A unit is white space and the word after it, or white space at the end. Units are found by arithmetic on whole texts as
integers of one bit a byte: ``bytes.translate`` gives the mask of white space, a shift and boolean operations leave a bit
where a unit ends, ``bit_count`` counts units, and halving the mask again and again finds the end of a unit by its number.
Characters are counted the same way, by the mask of bytes that begin one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and per cent of those that get suffix, prefix, middle; the seed of the draws.
CHANGED, SUFFIX_FIRST, SEED = 50, 80, 42
#: Bytes of texts that are handed back at a time.
TEXT_BYTES = 1 << 24

_SPACE = b" \t\n\v\f\r"
_IS_SPACE = bytes(ord("1") if b in _SPACE else ord("0") for b in range(256))
_BEGINS = bytes(ord("0") if 0x80 <= b < 0xC0 else ord("1") for b in range(256))


def mask(data: bytes, classes: bytes) -> int:
    """An integer with bit i set if `classes` has "1" for byte i."""
    return int(data.translate(classes)[::-1], 2) if data else 0


def unit_ends(data: bytes) -> int:
    """A mask with a bit at the last byte of each unit."""
    if not data:
        return 0
    space, last = mask(data, _IS_SPACE), 1 << len(data) - 1
    return ~space & (space >> 1 | last) | last


def place(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has `rank` set bits below it, in a mask of `width` bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - below, at + half
    return at


def parts(data: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """(n, a, b): how many units a text has, and the bytes at which prefix and middle end, as h1 and h2 draw them."""
    ends = unit_ends(data)
    n = ends.bit_count()
    a, b = (0 if not k else place(ends, k - 1, len(data)) + 1 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, a, b


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = markers
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text, h1, h2, h3, h4 in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if not text or h3 % 100 >= CHANGED or any(x in text for x in markers):
                yield doc_id, unit_ends(text).bit_count(), "plain", None, None, text
                continue
            n, a, b = parts(text, h1, h2)
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            begins = mask(text, _BEGINS)
            chars = (begins & (1 << a) - 1).bit_count(), (begins >> a & (1 << b - a) - 1).bit_count()
            if h4 % 100 < SUFFIX_FIRST:
                yield doc_id, n, "spm", *chars, b"".join([s, suffix, p, prefix, m, middle])
            else:
                yield doc_id, n, "psm", *chars, b"".join([p, prefix, s, suffix, m, middle])

    for batch in batches:
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column(1)), pa.int64())).to_pylist()
        at = 0
        for i, end in enumerate(ends):
            if i + 1 == len(ends) or end // TEXT_BYTES != ends[i + 1] // TEXT_BYTES:
                columns = zip(*rows(batch.slice(at, i + 1 - at)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
                at = i + 1


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 for a document: the first groups of eight hexadecimal digits of SHA-256 of seed, ":" and doc_id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def filled_in(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of docs(doc_id, text).

    n counts units. form is "plain" (output is the text; no counts of characters), "psm" or "spm". Empty and null texts,
    and texts that hold a marker, stay plain. Texts are worked on whole, of any length, in memory of a few times their
    own size. Rows without a doc_id all draw the same numbers; repeated rows come out alike, a row each; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).cast("binary").alias("text"))
    rows = rows.select("doc_id", "text", *draws(F.col("doc_id"), seed))
    out = rows.mapInArrow(_transformed, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker can begin in a part and end in a marker, so cutting at them is exact."""
    cut = F.split(output, "<[PSM]>")
    prefix_first = F.concat(F.get(cut, F.lit(1)), F.get(cut, F.lit(3)), F.get(cut, F.lit(2)))
    suffix_first = F.concat(F.get(cut, F.lit(2)), F.get(cut, F.lit(3)), F.get(cut, F.lit(1)))
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)
