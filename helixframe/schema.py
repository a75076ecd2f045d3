"""Column requirements of the logical tables, checked on the schema alone."""

from __future__ import annotations

from pyspark.sql import DataFrame

INTERVALS = ("chrom", "start", "end")
VARIANTS = ("chrom", "pos", "ref", "alt")
BASES = "ACGT"
#: Letters that a DNA string may hold, in the order of their integer codes.
CODES = "ACGTN"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or a ValueError that names the columns it lacks."""
    if lacking := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}; there are {', '.join(df.columns)}")
    return df
