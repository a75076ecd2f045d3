"""Running coverage of a stream of fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from helixframe.operators.coverage import insertion_counts


def running_insertions(fragments: DataFrame, plus_shift: int = 0, minus_shift: int = 0, chroms: Sequence[str] | None = None) -> DataFrame:
    """Insertion counts by (chrom, pos) of all fragments so far, for output mode update or complete."""
    if not fragments.isStreaming:
        raise ValueError("fragments are no stream; use insertion_counts")
    return insertion_counts(fragments, plus_shift, minus_shift, chroms)
