"""Metrics and distributions over predictions with labels: (id, task, pred, label)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.expand import gc_bin


def gc_distribution(seqs: DataFrame, binwidth: float = 0.1, normalize: bool = False) -> DataFrame:
    """(bin, n): sequences by GC fraction, empty bins too."""
    bins = seqs.sparkSession.range(math.ceil(1 / binwidth - 1e-9)).select(F.col("id").cast("int").alias("bin"))
    counts = seqs.groupBy(gc_bin(F.col("seq"), binwidth).alias("bin")).agg(F.count("*").alias("n"))
    out = bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return out.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("n")) if normalize else out


def gc_match_table(positives: DataFrame, negatives: DataFrame, binwidth: float = 0.1) -> DataFrame:
    both = [gc_distribution(x, binwidth, True).withColumn("kind", F.lit(k)) for k, x in (("positive", positives), ("negative", negatives))]
    return both[0].unionByName(both[1])


def effect_by_position(effects: DataFrame) -> DataFrame:
    """(pos, mean, sem, n, low, high): mean effect, its standard error (population deviation), and the
    95 % t interval of the mean; no interval for a single effect."""
    made = effects.groupBy("pos").agg(F.avg("effect").alias("mean"), (F.stddev_pop("effect") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))
    reach = t_quantile(F.col("n") - 1) * F.col("sem")
    return made.withColumns({"low": F.col("mean") - reach, "high": F.col("mean") + reach})


#: The 97.5 % quantiles of the t distribution with 1 to 6 degrees of freedom. Fixed values.
T_FEW = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851)


def t_quantile(freedom: Column) -> Column:
    """The 97.5 % quantile of the t distribution: from the table for few degrees of freedom, else by the
    expansion about the normal quantile, right to 1e-4; null for none."""
    z = 1.959963984540054
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    many = F.lit(z) + sum((F.lit(c) / F.pow(freedom, F.lit(i)) for i, c in enumerate(g, 1)), F.lit(0.0))
    few = F.get(F.array(*map(F.lit, T_FEW)), (freedom - 1).cast("int"))
    return F.when(freedom < 1, None).when(freedom <= len(T_FEW), few).otherwise(many)


def class_indicators(df: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` times the distinct values of ``column`` as ``class``, with ``value`` true where it is the
    row's own: a class label as one task a class."""
    classes = df.select(F.col(column).alias("class")).distinct()
    return df.join(classes, F.lit(True)).withColumn("value", F.col(column) == F.col("class"))


def calibration_curve(preds: DataFrame, by_task: bool = False) -> DataFrame:
    """Mean label by prediction rounded to tenths, halves to even."""
    return preds.groupBy(F.rint(F.col("pred") * 10).cast("int").alias("tenth"), *(["task"] if by_task else [])).agg(F.avg("label").alias("mean_label"), F.count("*").alias("n"))


def distribution(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("n"))


def running_counts(df: DataFrame, by: str, value: str, sums: dict[str, Column], ascending: bool = True, at: Column | None = None, ranges: int = 1000) -> DataFrame:
    """(by, value, and for each name of ``sums``: its sum over the rows of that value, ``…_before`` over
    those of the values before it, ``…_all`` over all rows of ``by``). Null values are left out.

    Equal values are first counted together. Running sums are taken within ranges of the value, by
    its place between least and largest or by ``at``, which must grow with it; the totals of
    the ranges before are added. So no group's rows meet in one partition unsplit.
    """
    points = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(*[c.alias(n) for n, c in sums.items()])
    if at is None:
        ends = points.groupBy(by).agg(F.min(value).alias("low__"), F.max(value).alias("high__"))
        place = (F.col(value) - F.col("low__")) / F.nullif(F.col("high__") - F.col("low__"), F.lit(0)) * ranges
        points = points.join(ends, by).withColumn("range__", F.coalesce(F.floor(place), F.lit(0))).drop("low__", "high__")
    else:
        points = points.withColumn("range__", at)
    turn = (lambda c: F.col(c)) if ascending else (lambda c: F.col(c).desc())
    whole, earlier = Window.partitionBy(by), Window.partitionBy(by).orderBy(turn("range__")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(by, "range__").orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy(by, "range__").agg(*[F.sum(n).alias(n) for n in sums])
    totals = totals.select(by, "range__", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}__b") for n in sums], *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums])
    inner = points.select(by, value, "range__", *sums, *[F.coalesce(F.sum(n).over(within), F.lit(0)).alias(f"{n}__i") for n in sums])
    met = inner.join(totals, [by, "range__"])
    return met.select(by, value, *sums, *[(F.col(f"{n}__i") + F.col(f"{n}__b")).alias(f"{n}_before") for n in sums], *[f"{n}_all" for n in sums])


def quantiles(df: DataFrame, value: str, by: str, shares: dict[str, float]) -> DataFrame:
    """(by, and a column for each name of ``shares``): exact quantiles, interpolated between the two
    rows next to the place. No group's values are held in one buffer."""
    counts = running_counts(df, by, value, {"n": F.count("*")})
    last = F.col("n_all") - 1
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (last * q).alias("place")) for name, q in shares.items()]))
    first, after = F.col("n_before"), F.col("n_before") + F.col("n")
    held = counts.withColumn("q", wanted).select(by, value, "q.name", "q.place", first.alias("first"), after.alias("after"))
    low, high = F.floor("place"), F.ceil("place")
    inside = lambda i: (F.col("first") <= i) & (i < F.col("after"))
    both = held.filter(inside(low) | inside(high)).groupBy(by, "name", "place").agg(F.max(F.when(inside(low), F.col(value))).alias("a"), F.max(F.when(inside(high), F.col(value))).alias("b"))
    made = both.withColumn("v", F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - low))
    return made.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])


def box_statistics(df: DataFrame, value: str, by: str) -> DataFrame:
    return quantiles(df, value, by, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def mse(preds: DataFrame) -> DataFrame:
    return preds.groupBy("task").agg(F.avg(F.pow(F.col("pred") - F.col("label"), 2)).alias("mse"))


def pearson(preds: DataFrame) -> DataFrame:
    return preds.groupBy("task").agg(F.corr("pred", F.col("label").cast("double")).alias("pearson"))


def task_metrics(preds: DataFrame) -> DataFrame:
    """(task, mse, pearson, accuracy) in one pass over the predictions."""
    right = F.when((F.col("pred") > 0.5) == (F.col("label") > 0.5), 1.0).otherwise(0.0)
    return preds.groupBy("task").agg(F.avg(F.pow(F.col("pred") - F.col("label"), 2)).alias("mse"), F.corr("pred", F.col("label").cast("double")).alias("pearson"), F.avg(right).alias("accuracy"))


def precision_recall(preds: DataFrame) -> DataFrame:
    """(task, pred, tp, n, positives, tp_own, n_own): counts of rows with at least each distinct prediction."""
    counts = running_counts(preds, "task", "pred", {"tp": F.sum(F.col("label").cast("long")), "n": F.count("*")}, ascending=False)
    return counts.select("task", "pred", (F.col("tp_before") + F.col("tp")).alias("tp"), (F.col("n_before") + F.col("n")).alias("n"), F.col("tp_all").alias("positives"), F.col("tp").alias("tp_own"), F.col("n").alias("n_own"))


def curve_metrics(preds: DataFrame) -> DataFrame:
    """(task, best_f1, average_precision, auroc) from one precision-recall curve. The last is the
    chance that a positive is ranked above a negative, ties counting half."""
    p, r = F.col("tp") / F.col("n"), F.col("tp") / F.col("positives")
    negatives, better = F.col("n_own") - F.col("tp_own"), F.col("tp") - F.col("tp_own") + F.col("tp_own") / 2
    made = precision_recall(preds).groupBy("task").agg(
        F.max(2 * p * r / (p + r + 1e-20)).alias("best_f1"),
        F.sum(p * F.col("tp_own") / F.col("positives")).alias("average_precision"),
        F.sum(negatives * better).alias("area"), F.max("positives").alias("pos"), F.sum(negatives).alias("neg"),
    )
    return made.select("task", "best_f1", "average_precision", (F.col("area") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auroc"))


def best_f1(preds: DataFrame) -> DataFrame:
    return curve_metrics(preds).select("task", "best_f1")


def average_precision(preds: DataFrame) -> DataFrame:
    return curve_metrics(preds).select("task", "average_precision")


def auroc(preds: DataFrame) -> DataFrame:
    return curve_metrics(preds).select("task", "auroc")


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.groupBy("task").agg(F.avg(F.when((F.col("pred") > 0.5) == (F.col("label") > 0.5), 1.0).otherwise(0.0)).alias("accuracy"))


def argmax(preds: DataFrame, value: str = "pred", by: str = "id") -> DataFrame:
    """(by, task): the task with the highest value, the first by name of equals."""
    return preds.groupBy(by).agg(F.min_by("task", F.struct(-F.col(value), F.col("task"))).alias("task"))


def multiclass_accuracy(preds: DataFrame) -> DataFrame:
    said, true = argmax(preds), argmax(preds, "label").withColumnRenamed("task", "label")
    return said.join(true, "id").agg(F.avg((F.col("task") == F.col("label")).cast("int")).alias("accuracy"))


def _log_factorial(y: Column) -> Column:
    """Stirling's formula, as in a full Poisson loss; 0 for labels up to 1."""
    return F.when(y > 1, y * F.ln(y) - y + 0.5 * F.ln(2 * math.pi * y)).otherwise(0.0)


def evaluation_losses(preds: DataFrame, kinds: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    """One row with a column for each of ``kinds``, in one pass. poisson: predictions are logs of rates.
    mse. bce: predictions are logits, positives weigh as their task does. ce: logits over tasks,
    the true task's weight times its loss, over the number of ids."""
    p, y = F.col("pred"), F.col("label").cast("double")
    weight = F.lit(1.0)
    for task, w in (weights or {}).items():
        weight = F.when(F.col("task") == task, float(w)).otherwise(weight)
    soft = F.log1p(F.exp(-F.abs(p)))
    made = {
        "poisson": F.avg(F.exp(p) - y * p + _log_factorial(y)),
        "mse": F.avg(F.pow(p - y, 2)),
        "bce": F.avg(weight * y * (soft + F.greatest(-p, F.lit(0.0))) + (1 - y) * (soft + F.greatest(p, F.lit(0.0)))),
        "ce": F.sum(weight * y * (F.col("total__") - p)) / F.count_distinct("id") if "ce" in kinds else None,
    }
    if not set(kinds) <= set(made):
        raise ValueError("kinds are poisson, mse, bce and ce")
    if "ce" in kinds:
        # the largest logit is taken off first, so that large ones don't overflow
        own = Window.partitionBy("id")
        most = preds.withColumn("most__", F.max("pred").over(own))
        preds = most.withColumn("total__", F.col("most__") + F.ln(F.sum(F.exp(F.col("pred") - F.col("most__"))).over(own)))
    return preds.agg(*[made[k].alias(k) for k in kinds])


def evaluation_loss(preds: DataFrame, kind: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(loss): one number over all rows, see ``evaluation_losses``."""
    return evaluation_losses(preds, [kind], weights).withColumnRenamed(kind, "loss")


def poisson_multinomial_loss(preds: DataFrame, length: Column | int, total_weight: float = 1.0, eps: float = 1e-7, axis: str = "length") -> DataFrame:
    """Mean of a Poisson loss of totals and a multinomial loss of shares; (id, task, pos, pred, label)
    with predictions as rates."""
    over = Window.partitionBy("id", "task") if axis == "length" else Window.partitionBy("id", "pos")
    p, y = F.col("pred") + eps, F.col("label").cast("double") + eps
    both = preds.withColumn("total_p", F.sum(p).over(over)).withColumn("total_y", F.sum(y).over(over))
    poisson = (F.col("total_p") - F.col("total_y") * F.ln("total_p")) / length
    cross = -y * F.ln(p / F.col("total_p"))
    return both.agg(F.avg(total_weight * poisson + cross).alias("loss"))


def preds_with_labels(preds: DataFrame, labels: DataFrame, bins: Sequence[int] | None = None) -> DataFrame:
    """(id, task, pos, pred, label) of rows that both have."""
    both = preds.withColumnRenamed("value", "pred").join(labels.withColumnRenamed("value", "label"), ["id", "task", "pos"])
    return both if bins is None else both.filter(F.col("pos").isin(list(bins)))
