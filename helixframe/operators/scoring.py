"""Scoring sequences and putting predictions together. Predictions are (id, …, task, pos, value)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import Comparison, compare, mutate
from helixframe.operators.expand import first_mutants, pattern_scan, saturation_mutants
from helixframe.schema import BASES
from helixframe.scratch import Scratch, cut

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
#: The name of an aggregate, or a function from a column to an aggregate of it.
Aggregate = str | Callable[[Column], Column]


#: Rows of task metadata up to which they are broadcast; beyond it Spark chooses.
BROADCAST_TASKS = 200_000


def aggregate(how: Aggregate, value: Column) -> Column:
    return how(value) if callable(how) else AGGREGATES[how](value)


def linear_score(seq: Column, weights: dict[str, float]) -> Column:
    """Mean of the weights of a string's bases; other letters weigh 0."""
    sums = [(F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))) * float(w) for base, w in sorted(weights.items())]
    return sum(sums[1:], sums[0]) / F.nullif(F.length(seq), F.lit(0))


def score_linear(df: DataFrame, tasks: dict[str, dict[str, float]]) -> DataFrame:
    """Rows of ``df`` times tasks, with ``value`` by each task's linear scorer; ``seq`` dropped."""
    scored = F.array(*[F.struct(F.lit(t).alias("task"), linear_score(F.col("seq"), w).alias("value")) for t, w in tasks.items()])
    return df.withColumn("x__", F.explode(scored)).select(*[c for c in df.columns if c != "seq"], "x__.task", "x__.value")


def score_sequences(df: DataFrame, load: Callable[[], Callable[[list[str]], pd.DataFrame]], keep: Sequence[str] = ("id",), schema: str = "task string, value double") -> DataFrame:
    """Batch inference with a user's model: ``load`` runs once a task and gives a function
    from sequences to a frame that has ``row`` (index of the sequence) and the schema's columns."""
    kinds = dict(df.dtypes)
    names = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            said = model(frame["seq"].tolist())
            held = frame[list(keep)].iloc[said["row"].to_numpy()].reset_index(drop=True)
            yield pd.concat([held, said[names].reset_index(drop=True)], axis=1)

    return df.select(*keep, "seq").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), schema]))


def select_predictions(preds: DataFrame, tasks: Sequence[str] | None = None, except_tasks: Sequence[str] | None = None, positions: Sequence[int] | None = None) -> DataFrame:
    if tasks is not None:
        preds = preds.filter(F.col("task").isin(list(tasks)))
    if except_tasks is not None:
        preds = preds.filter(~F.col("task").isin(list(except_tasks)))
    return preds if positions is None else preds.filter(F.col("pos").isin(list(positions)))


def aggregate_predictions(preds: DataFrame, keys: Sequence[str] = ("id",), length: Aggregate | None = "sum", task: Aggregate | None = "mean", weight: float = 1.0, **chosen) -> DataFrame:
    """Chosen tasks and positions put together over positions first, then over tasks."""
    made = select_predictions(preds, **chosen)
    held = [*keys, "task", "pos"]
    if length:
        held = [*keys, "task"]
        made = made.groupBy(*held).agg(aggregate(length, F.col("value")).alias("value"))
    if task:
        held = [c for c in held if c != "task"]
        made = made.groupBy(*held).agg(aggregate(task, F.col("value")).alias("value"))
    return made.select(*held, (F.col("value") * weight).alias("value"))


def specificity(preds: DataFrame, on_tasks: Sequence[str], off_tasks: Sequence[str], on: Aggregate = "mean", off: Aggregate = "mean", off_weight: float = 1.0, off_thresh: float | None = None, positions: Sequence[int] | None = None, length: Aggregate = "sum", how: Comparison = "divide") -> DataFrame:
    """(id, specificity): the on-tasks' value against the off-tasks', which counts times
    ``off_weight`` if it is above ``off_thresh``, or always if there is none. One pass."""
    summed = select_predictions(preds, tasks=[*on_tasks, *off_tasks], positions=positions).groupBy("id", "task").agg(aggregate(length, F.col("value")).alias("value"))
    is_on, is_off = F.col("task").isin(list(on_tasks)), F.col("task").isin(list(off_tasks))
    sides = summed.groupBy("id").agg(aggregate(on, F.when(is_on, F.col("value"))).alias("on"), aggregate(off, F.when(is_off, F.col("value"))).alias("off"))
    weighed = F.col("off") * off_weight
    if off_thresh is not None:
        weighed = F.when(F.col("off") > off_thresh, weighed).otherwise(F.col("off"))
    return sides.select("id", compare(F.col("on"), weighed, how).alias("specificity"))


def average_augmented(preds: DataFrame, keys: Sequence[str], length: Column | int, how: Aggregate = "mean") -> DataFrame:
    """Predictions of augmented copies (with ``rc``) turned back and put together."""
    turned = preds.withColumn("pos", F.when(F.col("rc"), length - 1 - F.col("pos")).otherwise(F.col("pos")))
    return turned.groupBy(*keys, "task", "pos").agg(aggregate(how, F.col("value")).alias("value"))


def activation(preds: DataFrame, kind: str) -> DataFrame:
    """exp, sigmoid, softmax over the tasks of each (id, pos), or none."""
    value = F.col("value")
    if kind == "softmax":
        over = Window.partitionBy("id", "pos")
        raised = preds.withColumn("e__", F.exp(value - F.max("value").over(over)))
        return raised.withColumn("value", F.col("e__") / F.sum("e__").over(over)).drop("e__")
    return preds.withColumn("value", {"exp": F.exp(value), "sigmoid": 1 / (1 + F.exp(-value)), "none": value}[kind])


def ensemble_predictions(models: dict[str, DataFrame]) -> DataFrame:
    """All models' predictions, tasks named by model and task."""
    parts = [p.withColumn("task", F.concat(F.lit(f"{name}_"), F.col("task"))) for name, p in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def task_lookup(preds: DataFrame, tasks: DataFrame, key: str = "task", names: Sequence[str] | None = None, invert: bool = False) -> DataFrame:
    """Predictions with their tasks' metadata; only of the named ones, or of all others."""
    if names is not None:
        chosen = F.col(key).isin(list(names))
        tasks = tasks.filter(~chosen if invert else chosen)
    # few tasks have many rows each: they are not to meet by a shuffle, in which each task is one key
    held = cut(tasks)
    return preds.join(F.broadcast(held) if held.count() <= BROADCAST_TASKS else held, "task")


def allele_effects(preds: DataFrame, how: Comparison = "divide", keys: Sequence[str] = ("id", "task")) -> DataFrame:
    """(…, effect): alternative against reference, from rows with ``allele_type``."""
    side = lambda s: F.max(F.when(F.col("allele_type") == s, F.col("value")))
    return preds.groupBy(*keys).agg(compare(side("alt"), side("ref"), how).alias("effect"))


def two_sided(z: Column) -> Column:
    """The two-sided normal p-value as an expression: the series of the error function for small values,
    its continued fraction for larger ones; right to about 1e-12."""
    x = F.abs(z) / F.lit(2.0**0.5)
    series, fraction = F.lit(1.0), x
    for n in range(40, 0, -1):
        series = F.lit(1.0) + 2 * x * x / (2 * n + 1) * series
        fraction = x + F.lit(n / 2) / fraction
    near = 1 - F.lit(2 / math.pi**0.5) * F.exp(-x * x) * x * series
    far = F.exp(-x * x) / F.lit(math.pi**0.5) / fraction
    return F.when(x < 2.5, near).otherwise(far)


def effect_zscores(effects: DataFrame, background: DataFrame) -> DataFrame:
    """``effects`` plus mean and population deviation of the background's effects (id, task, shuffle,
    effect), z, and the two-sided normal p-value."""
    stats = background.groupBy("id", "task").agg(F.avg("effect").alias("background_mean"), F.stddev_pop("effect").alias("background_sd"))
    z = (F.col("effect") - F.col("background_mean")) / F.nullif(F.col("background_sd"), F.lit(0.0))

    return effects.join(stats, ["id", "task"], "left").withColumn("z", z).withColumn("p_value", two_sided(F.col("z")))


def background_effects(preds: DataFrame, variant: str, how: Comparison = "subtract", keys: Sequence[str] = ("id", "shuffle", "task")) -> DataFrame:
    """Rows that have ``variant`` (a pattern, a place) against the row of their keys that has none."""
    base = preds.filter(F.col(variant).isNull()).select(*keys, F.col("value").alias("base__"))
    return preds.filter(F.col(variant).isNotNull()).join(base, list(keys)).withColumn("effect", compare(F.col("value"), F.col("base__"), how)).drop("base__")


#: From a sequence column to one score column a task.
Scorer = Callable[[Column], dict[str, Column]]


def linear_scorer(tasks: dict[str, dict[str, float]]) -> Scorer:
    return lambda seq: {t: linear_score(seq, w) for t, w in tasks.items()}


def score_by(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Rows of ``df`` times the scorer's tasks, with ``value``; ``seq`` dropped."""
    each = F.array(*[F.struct(F.lit(t).alias("task"), v.alias("value")) for t, v in scorer(F.col("seq")).items()])
    return df.withColumn("x__", F.explode(each)).select(*[c for c in df.columns if c != "seq"], "x__.task", "x__.value")


def _moments(pairs: DataFrame, keys: Sequence[str], scorer: Scorer, how: Comparison) -> DataFrame:
    """(keys, task, n, background_mean, background_sd) of the effects of rows (keys, with__, without__): both sequences
    of a background stand in one row, so effects need no join, and count, mean and squared deviations are
    put together before anything is shuffled: one row a key and task leaves a stage, whatever the number of backgrounds."""
    sides = scorer(F.col("with__")), scorer(F.col("without__"))
    each = F.array(*[F.struct(F.lit(t).alias("task"), compare(sides[0][t], sides[1][t], how).alias("effect")) for t in sides[0]])
    effects = pairs.select(*keys, F.explode(each).alias("x")).select(*keys, "x.task", "x.effect")
    return effects.groupBy(*keys, "task").agg(F.count("effect").alias("n"), F.avg("effect").alias("background_mean"), F.stddev_pop("effect").alias("background_sd"))


def variant_moments(backgrounds: DataFrame, scorer: Scorer, how: Comparison = "subtract") -> DataFrame:
    """(id, task, n, background_mean, background_sd): what a variant does in other surroundings. ``backgrounds`` is (id, ref,
    alt, seq), any number of rows a variant, such as shuffled windows; alleles are written in the middle."""
    return _moments(backgrounds.select("id", mutate(F.col("seq"), F.col("alt")).alias("with__"), mutate(F.col("seq"), F.col("ref")).alias("without__")), ["id"], scorer, how)


def pattern_moments(backgrounds: DataFrame, patterns: Sequence[str], scorer: Scorer, how: Comparison = "subtract") -> DataFrame:
    """(id, pattern, task, n, background_mean, background_sd): what writing a pattern in the middle of backgrounds (id, seq)
    does."""
    spread = backgrounds.withColumn("pattern", F.explode(F.array(*map(F.lit, patterns))))
    return _moments(spread.select("id", "pattern", mutate(F.col("seq"), F.col("pattern")).alias("with__"), F.col("seq").alias("without__")), ["id", "pattern"], scorer, how)


def tile_moments(shuffled: DataFrame, seqs: DataFrame | None, scorer: Scorer, how: Comparison = "subtract") -> DataFrame:
    """(id, tile_start, task, n, background_mean, background_sd): what shuffling a tile does, from ``expand.tile_shuffles``
    of ``seqs`` (id, seq). Without ``seqs`` each row of ``shuffled`` has its whole sequence in ``own``, and nothing is joined."""
    if seqs is None:
        both = shuffled.select("id", "tile_start", F.col("seq").alias("with__"), F.col("own").alias("without__"))
    else:
        both = shuffled.select("id", "tile_start", F.col("seq").alias("with__")).join(seqs.select("id", F.col("seq").alias("without__")), "id")
    return _moments(both, ["id", "tile_start"], scorer, how)


def against_moments(effects: DataFrame, moments: DataFrame, keys: Sequence[str] = ("id", "task")) -> DataFrame:
    """``effects`` (keys, effect) plus the background's n, mean and deviation, z, and the two-sided normal p-value."""
    z = (F.col("effect") - F.col("background_mean")) / F.nullif(F.col("background_sd"), F.lit(0.0))
    return effects.join(moments, list(keys), "left").withColumn("z", z).withColumn("p_value", two_sided(F.col("z")))


def _by_letter(df: DataFrame, tasks: dict[str, dict[str, float]], entries: Callable[[str, str, dict[str, Column], Column], list[Column]], positions: Sequence[int] | None = None) -> DataFrame:
    """(id, pos, columns of the entries): for each letter of a sequence the entries of that letter.

    A substitution changes two base counts, so scores come from the counts of the sequence and are the same at all places with
    one letter: they are made once for each letter and base of a sequence and looked up at its places. No mutated
    string is made. Sums run in the order of ``linear_score`` and give equal values. ``entries`` makes the structs of a letter and a
    task from (letter, task, values by base, own value); any letter that no weight is for is the letter "".
    """
    size, bases = F.length("seq"), sorted({b for w in tasks.values() for b in w})
    counted = df.withColumns({"size__": size, **{f"n__{b}": size - F.length(F.replace(F.col("seq"), F.lit(b), F.lit(""))) for b in bases}})

    def score(weights: dict[str, float], base: str | None = None, was: str | None = None) -> Column:
        parts = [(F.col(f"n__{b}") + (int(base == b) - int(was == b))) * float(w) for b, w in sorted(weights.items())]
        return sum(parts[1:], parts[0]) / F.col("size__")

    letters = sorted({*bases, *BASES})
    table = F.array(*[F.array(*[e for t, w in tasks.items() for e in entries(was, t, {b: score(w, b, was) for b in BASES}, score(w))]) for was in ["", *letters]])
    # the outer form: with the other, Spark adds a filter that cuts the letters a second time
    places = counted.filter("size__ > 0").select("id", "seq", table.alias("table__")).select("id", "table__", F.posexplode_outer(F.split("seq", "")).alias("pos", "was"))
    if positions is not None:
        places = places.filter(F.col("pos").isin(list(positions)))
    return places.select("id", "pos", F.explode_outer(F.get("table__", F.instr(F.lit("".join(letters)), F.col("was")))).alias("s")).select("id", "pos", "s.*")


def substitution_scores(df: DataFrame, tasks: dict[str, dict[str, float]], positions: Sequence[int] | None = None, drop_ref: bool = False) -> DataFrame:
    """(id, task, pos, base, own, value): each substitution's linear score and the sequence's own (see ``_by_letter``)."""

    def entries(was: str, task: str, values: dict[str, Column], own: Column) -> list[Column]:
        return [F.struct(F.lit(task).alias("task"), F.lit(b).alias("base"), own.alias("own"), v.alias("value")) for b, v in values.items() if not (drop_ref and b == was)]

    return _by_letter(df, tasks, entries, positions).select("id", "task", "pos", "base", "own", "value")


def ism_scores(df: DataFrame, tasks: dict[str, dict[str, float]], how: Comparison = "subtract", positions: Sequence[int] | None = None) -> DataFrame:
    """(id, task, pos, base, effect): each substitution's score against the sequence's own. Nothing is
    shuffled, and an effect is made once for each letter of a sequence and each base."""

    def entries(was: str, task: str, values: dict[str, Column], own: Column) -> list[Column]:
        return [F.struct(F.lit(task).alias("task"), F.lit(b).alias("base"), compare(v, own, how).alias("effect")) for b, v in values.items()]

    return _by_letter(df, tasks, entries, positions).select("id", "task", "pos", "base", "effect")


def ism_importance(df: DataFrame, tasks: dict[str, dict[str, float]]) -> DataFrame:
    """(id, task, pos, importance): mean of -log2(alt / ref) over the three other bases. It is made within the row; only
    sequences that share their id with another are put together by id and place."""

    def entries(was: str, task: str, values: dict[str, Column], own: Column) -> list[Column]:
        effects = [-compare(v, own, "log2FC") for b, v in values.items() if b != was]
        total = sum((F.coalesce(e, F.lit(0.0)) for e in effects), F.lit(0.0))
        return [F.struct(F.lit(task).alias("task"), total.alias("total"), sum((e.isNotNull().cast("long") for e in effects), F.lit(0)).alias("n"))]

    def mean(rows: DataFrame) -> DataFrame:
        return rows.select("id", "task", "pos", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("importance"))

    repeated = cut(df.groupBy(F.col("id").alias("id__")).agg(F.count("*").alias("n")).filter("n > 1").select("id__"))
    if repeated.isEmpty():
        return mean(_by_letter(df, tasks, entries))
    own, shared = (_by_letter(df.join(repeated, F.col("id").eqNullSafe(F.col("id__")), kind), tasks, entries) for kind in ("left_anti", "left_semi"))
    return mean(own).unionByName(mean(shared.groupBy("id", "task", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))))


def best_in_group(df: DataFrame, by: str = "start_seq", score: str = "total_score") -> DataFrame:
    """``df`` plus ``best_in_iter``: the best row of each group, the first by position and allele."""
    order = Window.partitionBy(by).orderBy(F.desc(score), "pos", "allele")
    return df.withColumn("best_in_iter", F.row_number().over(order) == 1)


def score_improved(rounds: DataFrame) -> DataFrame:
    """(iter, best, improved) from (iter, best), one row a round."""
    return rounds.withColumn("improved", F.coalesce(F.col("best") > F.lag("best").over(Window.orderBy("iter")), F.lit(True)))


def evolve(seqs: DataFrame, scorer: dict[str, float] | Callable[[DataFrame], DataFrame], method: str = "ism", patterns: Sequence[str] = (), max_iter: int = 10, positions: Sequence[int] | None = None, for_each: bool = True, stop: str = "all", by_counts: bool = False) -> DataFrame:
    """(iter, id, pos, allele, seq, total_score, best_in_iter): greedy design by the best single substitution (or
    written pattern) a round: of each start sequence, or with ``for_each`` False of all of them together, where
    the one best sequence goes on alone (of equals the first by id, position and allele).

    ``scorer`` is the weights of a linear scorer, or a function that adds ``total_score`` to rows
    that have ``seq``: an expression over it, or a user's model (``with_scores``). It ends when the
    best score of a round does not beat the last one's; that round is kept. With ``stop`` "each" a start
    leaves the rounds by itself as soon as its own best does not beat its last one, and the others go on.
    Rounds are written to the shared folder, and one row a round reaches the driver.

    ``by_counts`` says that a sequence's score depends on how many of each letter it has alone, as a linear scorer's does.
    Substitutions of one letter by one base then score the same, and the first of them comes before the others: it alone
    is made (``first_mutants``, twelve a sequence of four letters), and only the rows that are the best of a round are
    returned. They are the rows that the longer way marks as best.
    """
    if stop not in ("all", "each"):
        raise ValueError("stop must be all or each")
    if by_counts and (method != "ism" or positions is not None or not for_each):
        raise ValueError("by_counts is for substitutions at all positions of each start")
    store = Scratch(seqs.sparkSession)
    score = scorer if callable(scorer) else lambda df: df.withColumn("total_score", linear_score(F.col("seq"), scorer))
    names = ["iter", "id", "pos", "allele", "seq", "total_score", "best_in_iter"]

    def marked(rows: DataFrame, turn: int) -> DataFrame:
        rows = rows.withColumn("iter", F.lit(turn))
        if by_counts:
            best = F.max_by(F.struct("pos", "allele", "seq", "total_score"), F.struct("total_score", -F.col("pos"), -F.ascii("allele")))
            return rows.groupBy("iter", "id").agg(best.alias("b")).select("iter", "id", "b.*", F.lit(True).alias("best_in_iter")).select(*names)
        if for_each:
            return best_in_group(rows, "id").select(*names)
        # the best of each task's rows, then of those: one small row
        rows = store.cut(rows)
        best = rows.agg(F.min_by(F.struct("id", "pos", "allele"), F.struct(-F.col("total_score"), F.col("id"), F.col("pos"), F.col("allele"))).alias("b")).first()["b"]
        same = F.lit(False) if best is None else F.col("id").eqNullSafe(F.lit(best["id"])) & (F.col("pos") == best["pos"]) & (F.col("allele") == best["allele"])
        return rows.withColumn("best_in_iter", same).select(*names)

    start = score(seqs.select("id", F.lit(-1).alias("pos"), F.lit("").alias("allele"), "seq"))
    first = store.cut(start.withColumn("iter", F.lit(0)).withColumn("best_in_iter", F.lit(True)).select(*names) if for_each else marked(start, 0))
    rounds, now = [first], first.filter("best_in_iter").select("id", "seq", F.col("total_score").alias("last__"))
    best = first.agg(F.max("total_score").alias("b")).first()["b"]
    for turn in range(1, max_iter + 1):
        step = now.select("id", "seq")
        mutants = first_mutants(step) if by_counts else saturation_mutants(step, positions, drop_ref=True) if method == "ism" else None
        made = mutants.withColumnRenamed("base", "allele") if mutants is not None else pattern_scan(step, patterns, positions).withColumnRenamed("pattern", "allele")
        scored = store.cut(marked(score(made), turn))
        rounds.append(scored)
        ahead = scored.filter("best_in_iter").select("id", "seq", "total_score")
        if stop == "each":
            # starts that did not get better leave
            now = store.cut(ahead.join(now.select("id", "last__"), "id").filter("total_score > last__").select("id", "seq", F.col("total_score").alias("last__")))
            if now.isEmpty():
                break
            continue
        top = scored.agg(F.max("total_score").alias("b")).first()["b"]
        if top is None or top <= best:
            break
        best, now = top, ahead.select("id", "seq", F.col("total_score").alias("last__"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def with_scores(df: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[float]]], out: str = "total_score") -> DataFrame:
    """``df`` plus a user's model's score of each ``seq``; ``load`` runs once a task."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for seqs in batches:
            yield pd.Series(model(seqs.tolist()), dtype="float64")

    return df.withColumn(out, scored(F.col("seq")))


def context_effect(preds: DataFrame) -> DataFrame:
    """(id, effect): mean of (wild type - mutant) / wild type over shuffles; rows (id, wt, mut)."""
    return preds.groupBy("id").agg(F.avg((F.col("wt") - F.col("mut")) / F.nullif(F.col("wt"), F.lit(0.0))).alias("effect"))


def sufficiency(preds: DataFrame) -> DataFrame:
    """(id, effect): mean of (mutant - control) / wild type; rows (id, wt, mut, control)."""
    return preds.groupBy("id").agg(F.avg((F.col("mut") - F.col("control")) / F.nullif(F.col("wt"), F.lit(0.0))).alias("effect"))


def specific_effects(effects: DataFrame, task: str, below: float, mean_at_least: float) -> DataFrame:
    """Ids whose effect in ``task`` is below a bound while their mean effect is not."""
    made = effects.groupBy("id").agg(F.avg("effect").alias("mean_effect"), F.max(F.when(F.col("task") == task, F.col("effect"))).alias("task_effect"))
    return made.filter((F.col("task_effect") < below) & (F.col("mean_effect") >= mean_at_least))


def tasks_by_variance(effects: DataFrame, n: int) -> DataFrame:
    """The ``n`` tasks whose mean effects vary most over motifs; rows (task, motif, effect)."""
    means = effects.groupBy("task", "motif").agg(F.avg("effect").alias("effect"))
    return means.groupBy("task").agg(F.var_samp("effect").alias("variance")).orderBy(F.desc("variance"), "task").limit(n)
