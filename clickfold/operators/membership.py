"""Semi-join by a hash bitmap, for key sets too large to broadcast as such.

The keys' hashes are set in a bitmap (about `bits_per_key` bits a key, at most
`max_bits` in all), built with Spark's bitmap aggregate and broadcast in pages
of 32768 bits. Rows whose hash is not set are dropped where they are scanned;
a few rows of other keys stay (about 1 in `bits_per_key`, more beyond
`max_bits`), so an exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 32768  # of Spark's bitmap aggregate
BITS_PER_KEY = 16
#: 32 MB of bitmap: what may be broadcast whatever the number of keys.
MAX_BITS = 1 << 28


def bitmap_size(keys: int, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> int:
    """Bits for so many keys: a power of two, one page at least."""
    bits = PAGE_BITS
    while bits < keys * bits_per_key and bits < max_bits:
        bits *= 2
    return bits


def _slot(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(bits - 1)


def key_bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(page, words): 1024 words of 32 bits for each page with a key in it."""
    slot = _slot(F.col(key), bits) + 1  # the bitmap functions count from 1
    pages = (
        keys.where(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(slot).alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    )
    return pages.select((F.col("page") - 1).alias("__page"), page_words(F.col("bits")).alias("__words"))


def page_words(bits: Column) -> Column:
    """A page of the bitmap aggregate as an array of 32-bit words."""
    word = lambda i: F.conv(F.hex(F.substring(bits, 4 * i + 1, 4)), 16, 10).cast("bigint")
    signed = lambda w: F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(PAGE_BITS // 32 - 1)), lambda i: signed(word(i)))


def is_set(words: Column, at: Column) -> Column:
    """Whether bit `at` (0 to 32767, int) of a page's words is set."""
    # byte p / 8 of the page, bit p % 8 of the byte; a word is four bytes, highest first
    shift = F.lit(24) - F.lit(8) * F.shiftright(at, 3).bitwiseAND(3) + at.bitwiseAND(7)
    return F.get(words, F.shiftright(at, 5)).bitwiseAND(F.call_function("shiftleft", F.lit(1), shift)) != 0


def only_members(rows: DataFrame, keys: DataFrame, key: str, n_keys: int, **size) -> DataFrame:
    """Rows whose `key` may be among `keys` (all of those that are)."""
    bits = bitmap_size(n_keys, **size)
    slot = _slot(F.col(key), bits)
    at = slot.bitwiseAND(PAGE_BITS - 1).cast("int")
    held = is_set(F.col("__words"), at)
    page = F.shiftright(slot, 15)
    bitmap = F.broadcast(key_bitmap(keys, key, bits))
    return rows.join(bitmap, (page == F.col("__page")) & held & F.col(key).isNotNull(), "left_semi")
