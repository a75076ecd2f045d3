"""Coverage: insertions of fragments, runs of equal depth, signal under intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.intervals import BIN, filter_overlapping, overlap_pairs
from helixframe.schema import INTERVALS, require_columns


def insertion_counts(fragments: DataFrame, plus_shift: int = 0, minus_shift: int = 0, chroms: Sequence[str] | None = None, within: DataFrame | None = None) -> DataFrame:
    """(chrom, pos, depth): fragment ends at each base; the end's own base is end - 1. ``within`` keeps the bases of some
    intervals only, before anything is shuffled."""
    require_columns(fragments, *INTERVALS)
    if chroms is not None:
        fragments = fragments.filter(F.col("chrom").isin(list(chroms)))
    ends = F.explode(F.array(F.col("start") + plus_shift, F.col("end") + minus_shift - 1)).alias("pos")
    bases = fragments.select("chrom", ends)
    if within is not None:
        bases = filter_overlapping(bases.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), within).select("chrom", F.col("start").alias("pos"))
    return bases.groupBy("chrom", "pos").agg(F.count("*").alias("depth"))


def merge_runs(depths: DataFrame, span: int = 1_000_000) -> DataFrame:
    """(chrom, start, end, value): neighbouring bases of equal depth as one run.

    Runs are found within stretches of ``span`` bases, so a window's partition is bounded, and
    those that touch at a stretch's edge are joined in a second, much smaller pass.
    """
    stretch = depths.withColumn("stretch", F.floor(F.col("pos") / span)).select("chrom", "stretch", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("depth").alias("value"))

    def joined(runs: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start")
        new = (F.lag("end").over(order) != F.col("start")) | (F.lag("value").over(order) != F.col("value"))
        marked = runs.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("value").alias("value")).drop("run")

    inner = joined(stretch, "chrom", "stretch").drop("stretch")
    edge = (F.col("start") % span == 0) | (F.col("end") % span == 0)
    names = ["chrom", "start", "end", "value"]
    return inner.filter(~edge).select(*names).unionByName(joined(inner.filter(edge), "chrom").select(*names))


def coverage_over_intervals(df: DataFrame, runs: DataFrame, how: str = "sum", width: int = BIN) -> DataFrame:
    """(id, value): sum, mean, max or min over an interval's bases of the signal under it.
    Bases without a run count as 0, so an interval without any has 0."""
    require_columns(runs, *INTERVALS, "value")
    pairs = overlap_pairs(df, runs, width, carry=("value",))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    sums = pairs.groupBy("id").agg(F.sum(F.col("value") * shared).alias("sum"), F.sum(shared).alias("covered"), F.max("value").alias("max"), F.min("value").alias("min"))
    size, none = F.col("end") - F.col("start"), F.lit(0)
    whole = F.col("covered") >= size
    value = {
        "sum": F.coalesce("sum", none).cast("double"),
        "mean": F.coalesce("sum", none).cast("double") / size,
        "max": F.when(whole, F.col("max")).otherwise(F.greatest(F.coalesce("max", none), none)).cast("double"),
        "min": F.when(whole, F.col("min")).otherwise(F.least(F.coalesce("min", none), none)).cast("double"),
    }[how]
    return df.join(sums, "id", "left").select("id", value.alias("value"))


def bin_signal(signal: DataFrame, bin_size: int, how: str = "sum") -> DataFrame:
    """(id, task, pos, value) with positions put together by ``bin_size``."""
    made = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]("value")
    return signal.groupBy("id", "task", F.floor(F.col("pos") / bin_size).alias("pos")).agg(made.alias("value"))
