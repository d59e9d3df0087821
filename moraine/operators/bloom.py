"""Bloom filters, as tables of bits and as one row of 64-bit words.

Double hashing with the two 32-bit halves of an MD5 prefix, so that any engine gives the same bits.  A
filter of up to ``PACKED_BITS`` is packed into one row, which is broadcast and tested by an expression; a
larger one stays a table and is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.schemas import FALSE_POSITIVE_RATE


#: Bits of a filter that is packed (4 MB, about 3.5 million keys at 1 per cent).
PACKED_BITS = 32 << 20

#: Words of a filter that are put in order in one task; the last task only puts such blocks together.
BLOCK_WORDS = 1024


def parameters(n: int, rate: float = FALSE_POSITIVE_RATE) -> tuple[int, int]:
    """Bits and hashes for ``n`` keys (at least one)."""
    n = max(n, 1)
    bits = math.ceil(-n * math.log(rate) / (math.log(2) * math.log(2)))
    return bits, max(1, math.ceil(bits / n * math.log(2)))


def parameter_columns(n: Column, rate: Column) -> tuple[Column, Column]:
    n = F.greatest(n, F.lit(1))
    bits = F.ceil(-n * F.log(rate) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("long")
    return bits, F.greatest(F.lit(1), F.ceil(bits / n * F.log(F.lit(2.0)))).cast("long")


def _half(key: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), at, 8), 16, 10).cast("long")


def probes(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Each key with the bits that it sets or asks for."""
    out = keys.select("key", _half(F.col("key"), 1).alias("h1"), _half(F.col("key"), 9).alias("h2"), F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("i"))
    return out.select("key", F.pmod(F.col("h1") + F.col("i") * F.col("h2"), F.lit(bits)).alias("bit"))


def bits_of(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    return probes(keys, bits, hashes).select("bit").distinct()


def packed(filled: DataFrame, bits: int) -> DataFrame:
    """One row ``words``: the bits of ``filled`` in 64-bit words, bit b at place b % 64 of word b / 64."""
    size = -(-bits // 64)
    set_ = filled.groupBy(F.expr("bit div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("_bits"))
    every = filled.sparkSession.range(size).join(set_, F.col("id") == F.col("_word"), "left").select("id", F.coalesce("_bits", F.lit(0)).alias("_bits"))
    ordered = lambda at, x: F.transform(F.sort_array(F.collect_list(F.struct(at, x))), lambda w: w[x])
    blocks = every.groupBy(F.expr(f"id div {BLOCK_WORDS}").alias("_block")).agg(ordered("id", "_bits").alias("_words"))
    return blocks.agg(F.flatten(ordered("_block", "_words")).alias("words"))


def _bytes(word: Column) -> Column:
    """Hex digits of a 64-bit word, little-endian."""
    return F.regexp_replace(F.lpad(F.hex(word), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1")


def serialised(words: Column, bits: int, hashes: int) -> Column:
    """A filter as binary: number of bits and of hashes (64-bit little-endian), then the bits, eight to a
    byte, without the last word's unused bytes."""
    head = F.concat(_bytes(F.lit(bits).cast("long")), _bytes(F.lit(hashes).cast("long")))
    body = F.substring(F.array_join(F.transform(words, _bytes), ""), 1, 2 * -(-bits // 8))
    return F.unhex(F.concat(head, body))


def deserialised(data: Column) -> Column:
    """struct<bits, hashes, words> of a serialised filter; too few bytes are an error.  The digits of the
    bits are cut into words in one pass: a lambda that took its word from ``data`` would read all of it."""
    word = lambda digits: F.conv(_reversed(digits), 16, -10).cast("long")
    head = lambda at: word(F.rpad(F.hex(F.substring(data, at, 8)), 16, "0"))
    bits = head(1)
    short = (F.octet_length(data) < 16) | (F.octet_length(data) < 16 + F.ceil(bits / 8))
    size = (16 * F.greatest(F.ceil(bits / 64), F.lit(1))).cast("int")
    body = F.rpad(F.substring(F.hex(data), F.lit(33), size), size, F.lit("0"))
    words = F.transform(F.regexp_extract_all(body, F.lit(".{16}"), F.lit(0)), word)
    return F.when(short, F.raise_error(F.lit("a Bloom filter is cut off")).cast("struct<bits:bigint,hashes:bigint,words:array<bigint>>")).otherwise(F.struct(bits.alias("bits"), head(9).alias("hashes"), words.alias("words")))


def _reversed(digits: Column) -> Column:
    return F.regexp_replace(digits, "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1")


def tested(key: Column, words: Column, bits: int, hashes: int) -> Column:
    """Whether all bits of the key are set."""
    first, second, out = _half(key, 1), _half(key, 9), F.lit(True)
    for i in range(hashes):
        bit = F.pmod(first + i * second, F.lit(bits))
        out = out & (F.getbit(F.get(words, (bit / 64).cast("int")), (bit % 64).cast("int")) == 1)
    return out


def might_contain(asked: DataFrame, filled: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key``, ``maybe``: whether all bits of the key are set."""
    if bits <= PACKED_BITS:
        one = packed(filled, bits)
        return asked.select("key").distinct().join(F.broadcast(one), F.lit(True)).select("key", tested(F.col("key"), F.col("words"), bits, hashes).alias("maybe"))  # one row
    wanted = probes(asked.select("key").distinct(), bits, hashes).distinct()
    hit = wanted.join(filled.select("bit", F.lit(1).alias("_set")), "bit", "left")
    return hit.groupBy("key").agg((F.count("*") == F.count("_set")).alias("maybe"))
