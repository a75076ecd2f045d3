"""Training tables: windows with their sequences and labels.

Labels are rows (id, task, pos, value); a sequence's window is longer than the model's by twice the shifts,
so that ``expand.augment`` can move within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import label_transform, resize
from helixframe.operators.coverage import coverage_over_intervals
from helixframe.operators.genome import intervals_to_sequences
from helixframe.operators.intervals import resize_intervals


def labeled_sequences(df: DataFrame, seq_len: int, labels: list[str], max_seq_shift: int = 0, max_pair_shift: int = 0, end: str = "both") -> tuple[DataFrame, DataFrame]:
    """(id, seq) padded or cut to the window's length, and the label columns in long form."""
    size = seq_len + 2 * max_seq_shift + 2 * max_pair_shift
    return df.select("id", resize(F.col("seq"), size, end).alias("seq")), df.unpivot("id", labels, "task", "value").withColumn("pos", F.lit(0))


def interval_windows(df: DataFrame, chunks: DataFrame, seq_len: int, max_seq_shift: int = 0, max_pair_shift: int = 0, end: str = "both", chunk: int = 4096) -> DataFrame:
    """(id, seq) under the intervals brought to the window's length."""
    return intervals_to_sequences(resize_intervals(df, seq_len + 2 * max_seq_shift + 2 * max_pair_shift, end), chunks, chunk)


def matrix_windows(var: DataFrame, matrix: DataFrame, chunks: DataFrame, seq_len: int, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Windows of the vars (var, chrom, start, end) and their values with observations as tasks."""
    intervals = var.withColumnRenamed("var", "id")
    labels = matrix.join(var.select("var"), "var", "left_semi").select(F.col("var").alias("id"), F.col("obs").alias("task"), F.lit(0).alias("pos"), "value")
    return interval_windows(intervals, chunks, seq_len, chunk=chunk), labels


def coverage_windows(df: DataFrame, tracks: DataFrame, label_len: int, bin_size: int, how: str = "sum", low: float | None = None, high: float | None = None, transform: str | None = None) -> DataFrame:
    """(id, task, pos, value): signal of each track (track, chrom, start, end, value) in bins of the
    window of ``label_len`` around each interval's middle, clipped and transformed. Bins
    without signal are 0."""
    bins = resize_intervals(df, label_len).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(label_len // bin_size - 1))))
    tasks = tracks.select(F.col("track").alias("task")).distinct()  # one row a track
    cells = bins.join(tasks, F.lit(True)).select(F.struct("id", "task", "pos").alias("id"), F.to_json(F.struct("chrom", "task")).alias("chrom"), (F.col("start") + F.col("pos") * bin_size).alias("start"), (F.col("start") + (F.col("pos") + 1) * bin_size).alias("end"))
    runs = tracks.withColumn("chrom", F.to_json(F.struct("chrom", F.col("track").alias("task"))))
    signal = coverage_over_intervals(cells, runs, how)
    return signal.select("id.id", "id.task", "id.pos", label_transform(F.col("value"), low, high, transform).alias("value"))
