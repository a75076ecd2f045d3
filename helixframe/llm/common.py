"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.scratch import Scratch, cut, shared_folder  # noqa: F401 (the operators take them from here)

#: ASCII white space as the contracts define it: space and U+0009 to U+000D.
SPACE = r"[ \t-\r]"


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hints a broadcast only if ``rows``, which the caller has counted, is within ``limit``;
    beyond it Spark shuffles, and its adaptive execution splits skewed keys."""
    return F.broadcast(df) if rows <= limit else df


def words(text: Column, pattern: str = SPACE) -> Column:
    """Maximal runs of characters outside ``pattern``, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{pattern}+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairwise(items: Column, step: int = 1) -> Column:
    """The hash of each item with the one ``step`` places on, as long as there is one."""
    rest = F.greatest(F.size(items) - step, F.lit(0))
    return F.zip_with(F.slice(items, 1, rest), F.slice(items, step + 1, rest), lambda a, b: F.xxhash64(a, b))


def unit_hash(*cols: Column) -> Column:
    """A fixed draw from [0, 1) by the columns' values: the same for any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
