"""The first n of N rows by a drawn or a given order, without sorting N rows or bringing n to one task.

Rows are counted by buckets that follow the order. The bucket in which the n-th row lies is the edge: rows of
buckets before it are taken as they are, and only the edge's own rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a drawn order: a bucket has this part of all rows.
BUCKETS = 1 << 16
#: Bits of a drawn number: 15 hexadecimal digits.
BITS = 60


def hashed_order(seed: int, *key: str) -> Column:
    """A random order that depends on the key alone, not on the partitioning: 60 bits of the MD5 of seed and
    keys, joined by colons."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def drawn_bucket(order: Column) -> Column:
    """Equal parts of the range of ``hashed_order``."""
    return F.shiftright(order, BITS - (BUCKETS.bit_length() - 1))


def value_bucket(value: Column, parts: int = 1024) -> Column:
    """A whole number that never falls as ``value`` grows: ``parts`` for each doubling, by sign. Doubles
    have 2,100 doublings, so there are at most 4.3 million, and few in use."""
    size = F.floor(F.log2(F.abs(value)) * parts) + parts * 1100
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def first_n(df: DataFrame, n: int | Column, bucket: Column, *order: Column, by: str | None = None) -> DataFrame:
    """The first ``n`` rows in ``order``; all of them, if there are fewer. ``bucket`` is a number that never
    falls along the order. With ``by``, the first of each group, ``n`` being a column that is the same in
    all rows of a group.

    Nulls of ``bucket`` are not allowed. Two rows that are equal in ``order`` may come either way, so it should
    end in a key.
    """
    group = [by] if by else []
    marked = df.withColumn("cut__", bucket).withColumn("n__", n if isinstance(n, Column) else F.lit(n))
    counts = marked.groupBy(*group, "cut__").agg(F.count("*").alias("in__"), F.first("n__").alias("n__"))
    before = F.sum("in__").over(Window.partitionBy(*group).orderBy("cut__").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in__")
    # one row, or one a group: the last bucket that begins before the n-th row
    edge = counts.withColumn("before__", before).filter("before__ < n__").groupBy(*group).agg(F.max("cut__").alias("edge__"), F.max("before__").alias("before__"))
    if by:
        held = marked.join(edge, by)
    else:
        held = marked.withColumn("edge__", edge.select("edge__").scalar()).withColumn("before__", edge.select("before__").scalar())
    last = held.filter("cut__ = edge__").withColumn("nth__", F.row_number().over(Window.partitionBy(*group, "cut__").orderBy(*order)))
    return held.filter("cut__ < edge__").select(*df.columns).unionByName(last.filter("nth__ <= n__ - before__").select(*df.columns))
