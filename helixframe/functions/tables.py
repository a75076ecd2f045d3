"""Table functions for Spark SQL: one sequence to many rows, in a LATERAL join.

    tables.register(spark)
    spark.sql("SELECT id, t.* FROM seqs, LATERAL sequence_tiles(seq, 50, 25) t")
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from helixframe.schema import BASES


class SequenceTiles:
    """(tile_start, tile): every ``stride``-th stretch of ``size`` letters that lies whole in a sequence; none for null."""

    def eval(self, seq: str, size: int, stride: int):
        for start in range(0, len(seq or "") - size + 1, stride):
            yield start, seq[start : start + size]


class SequenceMutants:
    """(pos, base, was): every substitution of a sequence by one of A, C, G, T; none for null."""

    def eval(self, seq: str):
        for pos, was in enumerate(seq or ""):
            for base in BASES:
                if base != was:
                    yield pos, base, was


def register(spark: SparkSession) -> None:
    """Names the functions ``sequence_tiles`` and ``sequence_mutants`` in the session. Rows go to Python in
    Arrow batches."""
    spark.udtf.register("sequence_tiles", udtf(SequenceTiles, returnType="tile_start int, tile string", useArrow=True))
    spark.udtf.register("sequence_mutants", udtf(SequenceMutants, returnType="pos int, base string, was string", useArrow=True))
