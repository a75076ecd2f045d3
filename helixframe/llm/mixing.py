"""Mixing sources to target weights by iterative proportional fitting (operator 8). Spark expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, small, unit_hash, words

#: What stands for a null in a margin's column.
MISSING = "(none)"
#: Categories of a margin, and combinations of categories, up to which a table of them is broadcast.
BROADCAST_ROWS = 200_000
#: Combinations of categories, a row of sums each, up to which a round of raking is one task's.
AT_ONCE = 10_000
#: Letters that stand for the buckets of a term profile.
LETTERS = "abcdefghijklmnop"


def _terms(tokens: Column) -> Column:
    """A string with one letter a term: its hash bucket. Words of four letters or more are terms."""
    letter = lambda w: F.substring(F.lit(LETTERS), (F.pmod(F.xxhash64(F.lower(w)), F.lit(len(LETTERS))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.filter(tokens, lambda w: F.length(w) > 3), letter), "")


def _profile() -> Column:
    """Square roots of the buckets' shares of the column ``terms__``."""
    n = F.length("terms__")
    return F.array(*[F.sqrt((n - F.length(F.replace(F.col("terms__"), F.lit(x), F.lit("")))) / F.greatest(n, F.lit(1))) for x in LETTERS])


def _nearest(profile: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Index of the centre nearest to a profile, the first of equals."""
    held = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    far = lambda p, k: F.aggregate(F.zip_with(p, F.get(held, k), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, d: total + d)
    return F.array_min(F.transform(F.array_repeat(profile, len(centers)), lambda p, k: F.struct(far(p, k).alias("d"), k.alias("k"))))["k"]


def with_topics(docs: DataFrame, text: str = "text", out: str = "topic", tokens_out: str | None = None, topics: int = 8, rounds: int = 4, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) plus ``out``: which of ``topics`` centroids of hashed terms a
    whole text is nearest to, ``none`` for texts without terms; and its number of words in ``tokens_out``, if named.

    A profile is the share of a text's terms in each of 16 hash buckets. Texts are read once: profiles and numbers of
    words are written beside the kept columns. Centroids are fitted by nearest-mean rounds on the profiles of all
    texts, equal ones as one row with their number; the rounds start at the first distinct profiles by a hash. The
    driver gets the centroids alone, to nine digits, so that they don't depend on the partitioning.
    """
    store = Scratch(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (out, tokens_out)]
    # kept columns are held in a struct, so their names can't clash
    found = docs.select(F.struct(*kept).alias("kept"), words(F.col(text)).alias("words")).withColumn("terms__", _terms(F.col("words")))
    found = store.cut(found.select("kept", F.size("words").cast("long").alias("words"), F.when(F.col("terms__") != "", _profile()).alias("p")))
    rows = store.cut(found.filter("p IS NOT NULL").groupBy("p").agg(F.count("*").alias("n")))
    centers = [list(r["p"]) for r in rows.orderBy(F.xxhash64("p"), "p").limit(topics).collect()]
    means = F.array(*[F.round(F.sum(F.get("p", F.lit(i)) * F.col("n")) / F.sum("n"), 9) for i in range(len(LETTERS))]).alias("p")
    for _ in range(rounds if len(centers) > 1 else 0):
        for r in rows.groupBy(_nearest(F.col("p"), centers).alias("k")).agg(means).collect():
            centers[r["k"]] = list(r["p"])
    store.drop(rows)
    at = F.when(F.col("p").isNull(), "none").otherwise(F.concat(F.lit("topic "), _nearest(F.col("p"), centers).cast("string"))) if centers else F.lit("none")
    return found.select(*[F.col("kept")[c].alias(c) for c in kept], *([F.col("words").alias(tokens_out)] if tokens_out else []), at.alias(out))


def targets_of(cells: DataFrame, margin: str, given: Mapping[str, float] | None = None, power: float = 1.0) -> DataFrame:
    """(margin, target): target shares of the categories that are there, summing to 1. Categories
    ``given`` have their given share; the others share what is left of 1 by their token shares to
    ``power`` (below 1: flatter than found). Where all are given, shares are scaled to sum to 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    if given:
        known = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(float(v))) for k, v in given.items()]))
        sums = sums.withColumn("given", known[F.col(margin)])
    else:
        sums = sums.withColumn("given", F.lit(None).cast("double"))
    sums = sums.withColumn("size", F.when(F.col("given").isNull(), F.pow("tokens", F.lit(power))))
    total = sums.agg(F.sum("given").alias("given"), F.sum("size").alias("size")).first()
    taken, sized = total["given"] or 0.0, total["size"] or 0.0
    left = max(1.0 - taken, 0.0) if sized else 0.0
    whole = (taken + left) or 1.0
    return sums.select(margin, F.coalesce(F.col("given") / whole, F.col("size") * (left / whole / (sized or 1.0)), F.lit(0.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], start: float = 1.0, most: float | None = None, rounds: int = 40, tolerance: float = 1e-4, store: Scratch | None = None) -> DataFrame:
    """``cells`` (one row a combination of margins, with ``tokens``) plus ``weight``: ``start`` times a
    factor of each margin's category, and at most ``most``, such that every margin's shares of
    all weighted tokens, ``start`` times the tokens, are its targets.

    A step sums the weighted tokens of one margin's categories and scales the factors of their cells. It ends
    when within one round no share of any margin was off its target by more than ``tolerance``
    of the target, when a round brought the worst no nearer by a tenth (targets that can't be met
    together under ``most``), or after ``rounds`` rounds. A category whose target is more than all its tokens
    gives all of them and is not waited for. A cell holds its targets and the product of its factors, so a
    step is one sum and one join, and only the largest deviation reaches the driver. Up to ``AT_ONCE`` cells, the
    steps of a round are windows over one partition, one job in all.
    """
    store = store or Scratch(cells.sparkSession)
    found = cells.agg(F.sum("tokens").alias("all"), F.count("*").alias("n")).first()
    total, few = found["all"] or 1.0, found["n"] <= AT_ONCE
    sizes = {m: t.count() for m, t in targets.items()}
    held = cells
    for m, t in targets.items():
        held = held.join(small(t.select(m, (F.col("target") * (total * start)).alias(f"target__{m}")), sizes[m], BROADCAST_ROWS), m, "left")
    held = store.cut(held.withColumn("factor__", F.lit(float(start))).withColumns({f"off__{m}": F.lit(0.0) for m in targets}))
    weight = F.col("factor__") if most is None else F.least(F.col("factor__"), F.lit(float(most)))

    now, every = F.sum(F.col("tokens") * weight), F.sum("tokens")

    def step(m: str, target: Column) -> tuple[Column, Column]:
        """The ratio that scales a category's factors and how far its share was off, from now__ and most__."""
        ratio = target / F.nullif(F.col("now__"), F.lit(0.0))
        spent = F.col("now__") >= F.col("most__") * (float("inf") if most is None else most * (1 - 1e-9))
        stuck = spent & (ratio > 1)
        return F.when(stuck, 1.0).otherwise(F.coalesce(ratio, F.lit(1.0))), F.when(stuck, 0.0).otherwise(F.coalesce(F.abs(ratio - 1), F.lit(0.0)))

    last = float("inf")
    for _ in range(rounds if targets else 0):
        before = held
        if few:
            held = held.coalesce(1)
            for m in targets:
                of = Window.partitionBy(m)
                ratio, off = step(m, F.col(f"target__{m}"))
                held = held.withColumns({"now__": now.over(of), "most__": every.over(of)}).withColumns({"factor__": F.col("factor__") * ratio, f"off__{m}": off})
            held = store.cut(held.select(*before.columns))
            store.drop(before)
        for m in () if few else targets:
            ratio, off = step(m, F.col("target__"))
            sums = held.groupBy(m).agg(now.alias("now__"), every.alias("most__"), F.first(f"target__{m}").alias("target__"))
            scale = sums.select(m, ratio.alias("ratio__"), off.alias(f"off__{m}"))
            scaled = held.drop(f"off__{m}").join(small(scale, sizes[m], BROADCAST_ROWS), m, "left").withColumn("factor__", F.col("factor__") * F.coalesce("ratio__", F.lit(1.0)))
            before, held = held, store.cut(scaled.select(*held.columns))
            store.drop(before)
        worst = held.agg(F.max(F.greatest(F.lit(0.0), *[F.col(f"off__{m}") for m in targets], F.lit(0.0)))).first()[0] or 0.0
        if worst <= tolerance or worst > 0.9 * last:
            break
        last = worst
    return held.withColumn("weight", weight).select(*cells.columns, "weight")


def mix(docs: DataFrame, margins: Sequence[str], tokens: Column, targets: Mapping[str, Mapping[str, float]] | None = None, powers: Mapping[str, float] | None = None, budget: float = 0.5, key: Sequence[str] = ("doc_id",), seed: int = 17) -> DataFrame:
    """``docs`` plus ``mix_tokens``, ``mix_weight``, ``mix_probability`` and ``mix_kept``.

    Tokens are summed by the combination of ``margins`` (nulls are a category of their own,
    ``(none)``), which combines before it shuffles. ``targets`` names a margin's shares by
    category; categories without one share the rest by ``powers`` (see ``targets_of``). ``rake``
    gives each combination the probability that its documents are kept with, at most 1, such
    that the kept tokens are ``budget`` times all tokens and have every margin's target shares in
    expectation. ``mix_weight`` is the probability over the budget: how much the combination
    counts against an even sample. A document is kept if a draw fixed by ``seed`` and ``key`` lies
    below its probability, whatever the partitioning. Rows with equal keys are kept or
    dropped together; texts without tokens weigh nothing and are kept as their combination is.
    Columns of docs named as the four are replaced; other names can't clash.
    """
    store = Scratch(docs.sparkSession)
    named = [f"margin__{i}" for i in range(len(margins))]
    taken = docs.drop("mix_tokens", "mix_weight", "mix_probability", "mix_kept").withColumns({"mix_tokens": F.coalesce(tokens, F.lit(0)).cast("long"), **{n: F.coalesce(F.col(m).cast("string"), F.lit(MISSING)) for n, m in zip(named, margins)}})
    cells = store.cut(taken.groupBy(*named).agg(F.sum("mix_tokens").cast("double").alias("tokens")))
    wanted = {n: targets_of(cells, n, (targets or {}).get(m), (powers or {}).get(m, 1.0)) for n, m in zip(named, margins)}
    chances = store.cut(rake(cells, wanted, budget, 1.0, 10, 1e-3, store).select(*named, F.col("weight").alias("mix_probability")))
    given = taken.join(small(chances, chances.count(), BROADCAST_ROWS), named, "left")
    given = given.withColumn("mix_weight", F.col("mix_probability") / budget)
    kept = unit_hash(F.lit(seed), *[F.col(k) for k in key]) < F.col("mix_probability")
    return given.withColumn("mix_kept", kept).drop(*named).select(*taken.drop(*named).columns, "mix_weight", "mix_probability", "mix_kept")


def attained(mixed: DataFrame, margin: str, given: Mapping[str, float] | None = None, power: float = 1.0) -> DataFrame:
    """(category, target, expected, kept): a margin's target shares, and those of the tokens that are
    kept in expectation and by the draws, from what ``mix`` gives."""
    category = F.coalesce(F.col(margin).cast("string"), F.lit(MISSING)).alias("category")
    sums = mixed.groupBy(category).agg(F.sum("mix_tokens").cast("double").alias("tokens"), F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("e"), F.sum(F.when(F.col("mix_kept"), F.col("mix_tokens")).otherwise(0)).alias("k"))
    wanted = targets_of(sums, "category", given, power)
    total = sums.agg(F.sum("e").alias("te"), F.sum("k").alias("tk"))
    return sums.join(wanted, "category").join(F.broadcast(total), F.lit(True)).select("category", "target", (F.col("e") / F.col("te")).alias("expected"), (F.col("k") / F.col("tk")).alias("kept"))
