"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body (or its lambdas) read it."""
    return F.transform(F.array(value), body)[0]


def sliding(n: Column, width: int) -> Column:
    """Starts 0, 1, ... of the windows of ``width`` that fit into ``n``; empty if none fits."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


#: Elements appended one by one within a block, and bits of a row sieve with those of one of its buckets (Spark's own).
BLOCK, ROW_BITS, BUCKET_BITS = 128, 1 << 24, 32_768


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each value the result of ``step`` (associative) over those before it, from ``zero``; and one more, over all.

    Appending copies an array, so values are taken in blocks: n values cost n * BLOCK, not n * n.
    """

    def along(block: Column, first: Column) -> Column:
        return F.aggregate(block, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def joined(blocks: Column, firsts: Column) -> Column:
        inner = F.flatten(F.transform(blocks, lambda b, i: F.slice(along(b, F.get(firsts, i)), F.lit(1), F.size(b))))
        return F.concat(inner, F.array(F.element_at(firsts, -1)))

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
        return let(along(totals, zero), lambda firsts: joined(blocks, firsts))

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(values, i + 1, F.lit(BLOCK))
    )
    return let(blocks, over)


def sieve(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap over hashed keys (bucket, bits), of ROW_BITS bits (2 MB) however many keys there are."""
    places = keys.select((F.pmod(key, F.lit(ROW_BITS)) + 1).alias("place"))  # Spark counts buckets from 1
    return places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )


def sifted(rows: DataFrame, key: Column, sieve_: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether a sieve may hold the key; false is certain.

    The sieve is broadcast; its size has a fixed bound.
    """
    bucket, bits = free_names(rows, "bucket", "bits")
    place = F.pmod(key, F.lit(ROW_BITS))
    small = F.broadcast(sieve_.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
    joined = rows.join(small, (F.floor(place / BUCKET_BITS) + 1) == F.col(bucket), "left")
    at = place % BUCKET_BITS
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(bucket, bits)
