"""Peak-by-cell matrices in long form: (obs, var, value), where an absent row is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.metrics import quantiles
from helixframe.operators.selection import drawn_bucket, first_n, hashed_order, value_bucket


def filter_obs(obs: DataFrame, matrix: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    kept = obs.filter(keep)
    return kept, matrix.join(kept.select("obs"), "obs", "left_semi")


def filter_cells(obs: DataFrame, matrix: DataFrame, cutoff: int = 1000, count: str = "n_cells") -> tuple[DataFrame, DataFrame]:
    return filter_obs(obs, matrix, F.col(count) >= cutoff)


def var_totals(matrix: DataFrame, n_obs: int, how: str = "mean") -> DataFrame:
    """(var, total) over all observations, those without a row counting as 0."""
    n = F.count("*")
    made = {"mean": F.sum("value") / F.lit(n_obs), "sum": F.sum("value"), "max": F.when(n < n_obs, F.greatest(F.max("value"), F.lit(0))).otherwise(F.max("value")), "min": F.when(n < n_obs, F.least(F.min("value"), F.lit(0))).otherwise(F.min("value"))}[how]
    return matrix.groupBy("var").agg(made.alias("total"))


def filter_coverage(matrix: DataFrame, n_obs: int, method: str = "cutoff", cutoff: float = 1, how: str = "mean", negative_frac: float = 0.0, seed: int = 0) -> DataFrame:
    """(var, total, is_negative): the vars whose total is at least ``cutoff``; the ``cutoff``
    highest ones ("top"); or those at or above that percentile ("percentile").
    ``negative_frac`` adds so many of the others, as a share of the kept, by a seeded draw; only then
    the kept are counted when the table is made.
    """
    totals = var_totals(matrix, n_obs, how)
    if method == "cutoff":
        kept = totals.filter(F.col("total") >= cutoff)
    elif method == "top":
        kept = first_n(totals, int(cutoff), -value_bucket(F.col("total")), F.desc("total"), F.col("var"))
    elif method == "percentile":
        edge = quantiles(totals.withColumn("all__", F.lit(1)), "total", "all__", {"edge": cutoff / 100}).select("edge")
        kept = totals.join(F.broadcast(edge), F.col("total") >= F.col("edge")).drop("edge")  # one row
    else:
        raise ValueError("method must be cutoff, top or percentile")
    kept = kept.withColumn("is_negative", F.lit(False))
    if not negative_frac:
        return kept
    n, order = int(negative_frac * kept.count()), hashed_order(seed, "var")
    rest = first_n(totals.join(kept.select("var"), "var", "left_anti"), n, drawn_bucket(order), order, F.col("var"))
    return kept.unionByName(rest.withColumn("is_negative", F.lit(True)))


def matrix_profile(matrix: DataFrame, by: str, n_other: int) -> DataFrame:
    """How many entries each obs (or var) has above 0, and of which share of the others."""
    counts = matrix.filter("value > 0").groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / n_other)
