"""A mergeable Bloom filter as a table, for dropping sure misses before an exact join.

The filter is a table (word, bits) of the 64-bit words that are not zero, made
by an aggregate that combines on the map side; two filters of one size merge
by the same aggregate. To test keys its words are gathered into one row, whose
size is the filter's (MAX_BITS at most), and broadcast. What the filter lets
through is joined exactly, so its size changes the work, never the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 12, 5
MAX_BITS = 1 << 28          # 32 MiB


def size_for(n_keys: int) -> int:
    """Bits for n keys: a power of two, 1,024 to MAX_BITS."""
    bits = 1024
    while bits < n_keys * BITS_PER_KEY and bits < MAX_BITS:
        bits *= 2
    return bits


def _places(keys: list[str], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *[F.col(k) for k in keys]), F.lit(bits)) for i in range(HASHES)]


def build(df: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(word, bits) of the rows' keys; null is a value like any other."""
    places = df.select(F.explode(F.array(*_places(keys, bits))).alias("p"))
    one = F.expr("shiftleft(1L, cast(p % 64 AS int))")
    return places.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters of one size."""
    return reduce(DataFrame.unionByName, filters).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def with_maybe(df: DataFrame, keys: list[str], made: DataFrame, bits: int, name: str = "_maybe") -> DataFrame:
    """df with a boolean column: false where the key is surely not in the filter."""
    spark = df.sparkSession
    every = spark.range(bits // 64).select(F.col("id").alias("word")).join(made, "word", "left")
    row = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))),
                                lambda x: x["bits"]).alias("_words"))
    hit = reduce(lambda a, b: a & b, [
        F.get(F.col("_words"), F.floor(p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0
        for p in _places(keys, bits)])
    return df.crossJoin(F.broadcast(row)).withColumn(name, hit).drop("_words")
