"""Bloom filters over join keys: Spark's own aggregate and test, reached through one module."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

#: Bits for each key, the fewest bits, and the most that Spark builds.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 12, 512, 1 << 26
#: Keys of one filter; more are dealt to several by their hashes.
PIECE_KEYS = 4_000_000
#: Filters of more bytes are not written into the plan, whose text would grow with them, but read by a subquery.
LITERAL_BYTES = 1 << 16


def bits_for(keys: int) -> int:
    """The next power of two from BITS_PER_KEY for each key."""
    return min(MOST_BITS, 1 << (max(LEAST_BITS, BITS_PER_KEY * keys) - 1).bit_length())


def pieces_for(keys: int) -> int:
    """A power of two, so that few plans differ."""
    return 1 << (max(0, keys - 1) // PIECE_KEYS).bit_length()


def piece_of(hashes: Column, pieces: int) -> Column:
    return F.pmod(hashes, F.lit(pieces)).cast("int")


def key_hash(*keys: Column) -> Column:
    """Both sides of a join must be cast to one type before."""
    return F.xxhash64(*keys)


def bloom_aggregate(hashes: Column, keys: int) -> Column:
    """The filter as bytes; null over no rows."""
    make = InternalFunction._invoke_internal_function_over_columns
    return make("bloom_filter_agg", hashes, F.lit(max(1, keys)).cast("long"), F.lit(bits_for(keys)).cast("long"))


def might_contain(spark: SparkSession, filter_: bytes, hashes: Column) -> Column:
    """False only where the hash is not among those that the filter was built from."""
    jvm, session = spark._jvm, spark._jsparkSession
    held = F.lit(bytearray(filter_))
    if len(filter_) > LITERAL_BYTES:
        held = spark.createDataFrame([(bytearray(filter_),)], "filter binary").scalar()
    known, probe = (session.expression(c._jc) for c in (held, hashes))
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(known, probe)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(test))
