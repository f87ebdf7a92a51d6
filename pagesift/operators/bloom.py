"""A Bloom filter as DataFrame expressions: built by one aggregate over the keys, tested inside the rows of another
table, so that rows without a partner are dropped before anything costly is done with them and nothing is shuffled.

The filter is an array of 64-bit words with two bits a key.  Its size follows the number of keys up to ``MOST_WORDS``;
with more keys it lets more rows through, never fewer, so an exact join must follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**20 words are 8 MB, enough for some four million keys at 16 bits a key.
MOST_WORDS = 1 << 20
BITS_PER_KEY = 16


def _places(h: Column, words: int) -> tuple[Column, Column]:
    """The places of a hash's two bits in the whole filter; ``words`` is a power of two."""
    last = F.lit(words * 64 - 1).cast("bigint")
    return h.bitwiseAND(last), F.shiftrightunsigned(h, 29).bitwiseAND(last)


def bloom_filter(hashes: DataFrame, hash_col: str, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """(one row with ``bloom``, its number of words) over the distinct non-null 64-bit hashes."""
    keys = hashes.select(F.col(hash_col).alias("_h")).where(F.col("_h").isNotNull()).distinct()
    n, words = keys.count(), 1
    while words < MOST_WORDS and words * 64 < n * bits_per_key:
        words *= 2
    bits = keys.select(F.explode(F.array(*_places(F.col("_h"), words))).alias("_bit"))
    one = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    filled = bits.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "_word").join(filled, "_word", "left")
    all_ = every.agg(F.array_sort(F.collect_list(F.struct("_word", F.coalesce("_bits", F.lit(0)).cast("bigint").alias("_bits")))).alias("_all"))
    return all_.select(F.transform("_all", lambda x: x["_bits"]).alias("bloom")), words


def might_contain(bloom: Column, words: int, h: Column) -> Column:
    """False only for hashes that the filter was not built from; null for a null hash."""
    def bit(place):
        return F.getbit(F.get(bloom, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1

    a, b = _places(h, words)
    return bit(a) & bit(b)


def keep_possible(rows: DataFrame, key: Column, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """``rows`` whose key may be among ``wanted``'s: a narrow filter, the same plan at every size.  Null keys go."""
    hashes = wanted.select(F.when(F.col(wanted_col).isNotNull(), F.xxhash64(wanted_col)).alias("_h"))
    bloom, words = bloom_filter(hashes, "_h")
    hashed = rows.withColumn("_h", F.when(key.isNotNull(), F.xxhash64(key)))
    return hashed.where(might_contain(bloom.scalar(), words, F.col("_h"))).drop("_h")
