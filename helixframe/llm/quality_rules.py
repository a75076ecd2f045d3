"""Quality rules with robust multivariate outliers (operator 4). Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, pairwise, small, words

#: Statistics of a vector: name -> (transformed value, least standard deviation). The floor
#: keeps a statistic that is the same in nearly all documents, so that its robust variance is
#: zero, from rejecting on any difference at all.
FEATURES: dict[str, tuple[str, float]] = {
    "length": ("ln(1 + n_words)", 0.5),
    "word_length": ("ln(word_chars / greatest(n_words, 1) + 0.1)", 0.08),
    "symbols": ("sqrt(n_symbols / greatest(word_chars, 1))", 0.04),
    "repeats": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.12),
    "capitals": ("sqrt(n_capitals / greatest(word_chars, 1))", 0.05),
    "lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.12),
}
#: Fraction of a group's rows that the estimate rests on.
SUBSET = 0.75
#: Makes the covariance of the central three quarters of six normal variables that of all.
CONSISTENCY = 1.3616
#: Square of the Mahalanobis distance beyond which a document is an outlier: the 1 - 1e-6
#: quantile of chi-square with six degrees of freedom.
CUTOFF = 38.258
#: A group of n rows has the share n / (n + these) in its centre and in its covariance; the rest of the
#: share goes to its language's, and of that in the same way to those of all documents.
CENTER_ROWS, COVARIANCE_ROWS = 5, 100
#: Groups up to which estimates are broadcast.
BROADCAST_GROUPS = 100_000


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_capitals
    (long) of the whole text; all 0 for a null or empty text.

    Repeated windows are found within the row: windows are hashed, sorted with their place,
    and marked where a neighbour has the same hash. Rows without a repeated hash skip that.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    step = docs.withColumn("words__", words(F.col(text))).withColumn("lines__", lines)
    step = step.withColumn("n_words", F.size("words__").cast("long"))
    step = step.withColumn("word_chars", F.length(F.array_join("words__", "")).cast("long"))
    step = step.withColumn("n_symbols", (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", ""))).cast("long"))
    step = step.withColumn("n_capitals", (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}", ""))).cast("long"))
    step = step.withColumn("n_lines", F.size("lines__").cast("long"))
    step = step.withColumn("n_dup_lines", (F.size("lines__") - F.size(F.array_distinct("lines__"))).cast("long"))
    step = step.withColumn("one__", F.transform("words__", lambda w: F.xxhash64(w))).drop("words__", "lines__")
    for new, old, apart in (("two__", "one__", 1), ("four__", "two__", 2), ("eight__", "four__", 4)):
        step = step.withColumn(new, pairwise(F.col(old), apart)).drop(old)
    step = step.withColumn("again__", F.size(F.array_distinct("eight__")) < F.size("eight__"))
    placed = F.array_sort(F.transform("eight__", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    step = step.withColumn("placed__", F.when(F.col("again__"), placed)).drop("eight__", "again__")
    size = F.size("placed__")
    none = F.array(F.lit(None).cast("bigint"))
    hashes = F.col("placed__.h")
    sides = F.arrays_zip(F.col("placed__").alias("own"), F.concat(none, F.slice(hashes, 1, size - 1)).alias("before"), F.concat(F.slice(hashes, 2, size - 1), none).alias("after"))
    alike = F.filter(sides, lambda x: x["own"]["h"].eqNullSafe(x["before"]) | x["own"]["h"].eqNullSafe(x["after"]))
    step = step.withColumn("places__", F.when(size > 0, F.sort_array(F.transform(alike, lambda x: x["own"]["p"])))).drop("placed__")
    # each repeated window covers 8 words, or as many as lie before the next one
    count = F.size("places__")
    gaps = F.zip_with(F.slice("places__", 2, count - 1), F.slice("places__", 1, count - 1), lambda after, own: F.least(after - own, F.lit(8)))
    covered = F.aggregate(gaps, F.lit(8).cast("long"), lambda total, gap: total + gap)
    return step.withColumn("n_repeat_words", F.when(count > 0, covered).otherwise(F.lit(0)).cast("long")).drop("places__")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _moments(rows: DataFrame, *by: str, also: tuple[Column, ...] = ()) -> DataFrame:
    """Means and covariance of x by the given columns, with the variance floors added; and the sums ``also``.
    Only x and its products are summed: x lies near 0 (see ``estimates``), and a plan with four sums for each
    covariance weighs on the driver in every step."""
    floors = [floor for _, floor in FEATURES.values()]
    sums = [*[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(FEATURES))], *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in _pairs()]]
    found = rows.groupBy(*by).agg(*sums, *also)
    made = {f"p{i}_{j}" for i, j in _pairs()}
    kept = [c for c in found.columns if c not in made]
    return found.selectExpr(*kept, *[f"(p{i}_{j} - m{i} * m{j}) * {CONSISTENCY}D + {floors[i] ** 2 if i == j else 0.0}D AS c{i}_{j}" for i, j in _pairs()])


def _inverted(out: DataFrame) -> DataFrame:
    """Adds the inverse k of the covariance c, and the logarithm of its determinant, by sweeping the matrix
    on each of its diagonal elements in turn. Narrow: one row a group."""
    p = len(FEATURES)
    whole = F.array(*[F.array(*[F.col(f"c{max(i, j)}_{min(i, j)}") for j in range(p)]) for i in range(p)])

    def sweep(state: Column, k: Column) -> Column:
        pivot = F.get(F.get(state["m"], k), k)

        def cell(row: Column, i: Column):
            other = lambda v, j: v - F.get(row, k) * F.get(F.get(state["m"], k), j) / pivot
            return lambda v, j: F.when((i == k) & (j == k), -1 / pivot).when((i == k) | (j == k), v / pivot).otherwise(other(v, j))

        swept = F.transform(state["m"], lambda row, i: F.transform(row, cell(row, i)))
        return F.struct(swept.alias("m"), (state["log_det"] + F.log(pivot)).alias("log_det"))

    state = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.struct(whole.alias("m"), F.lit(0.0).alias("log_det")), sweep)
    made = out.withColumn("state__", state)
    return made.selectExpr("*", *[f"-state__.m[{i}][{j}] AS k{i}_{j}" for i, j in _pairs()], "state__.log_det AS log_det").drop("state__")


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns x, m and k."""
    return F.expr(" + ".join(f"{1 if i == j else 2} * k{i}_{j} * (x{i} - m{i}) * (x{j} - m{j})" for i, j in _pairs()))


def mcd(rows: DataFrame, store: Scratch, most_steps: int = 12, settled: float = 1e-4) -> DataFrame:
    """(g, n, m, c, log_det) from (g, x): the minimum-covariance-determinant estimate of each group.

    Two starts, one from medians and one from all rows of the group, are improved by
    concentration steps: the estimate is made again from the three quarters of the group that lie
    nearest to it. Steps end when no determinant changes any more (or after ``most_steps``).
    The start with the smaller determinant wins. All steps are aggregations that combine
    before they shuffle, so one group may hold any share of the rows; the estimates are
    broadcast only up to ``BROADCAST_GROUPS`` groups.
    """
    p = len(FEATURES)
    floors = [floor for _, floor in FEATURES.values()]
    middle = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q{i}") for i in range(p)])
    spread = lambda i: f"pow((q{i}[2] - q{i}[0]) / 1.349, 2) + {floors[i] ** 2}D"
    first = middle.selectExpr("g", "n", "0 AS start", *[f"q{i}[1] AS m{i}" for i in range(p)], *[f"{spread(i) if i == j else '0D'} AS c{i}_{j}" for i, j in _pairs()])
    every = _moments(rows, "g").withColumns({"start": F.lit(1), "n": F.lit(None).cast("long")})
    found = store.cut(_inverted(first.unionByName(every)).withColumn("moved", F.lit(1.0)))
    sizes = store.cut(found.filter("start = 0").select("g", "n"))
    n_groups = sizes.count()
    for _ in range(most_steps):
        now = small(found.drop("n", "moved"), 2 * n_groups, BROADCAST_GROUPS)
        at = rows.join(now, "g").withColumn("distance", _distance()).select("g", "start", "distance", F.col("log_det").alias("old"), *[f"x{i}" for i in range(p)])
        near = at.groupBy("g", "start").agg(F.percentile_approx("distance", F.lit(SUBSET), F.lit(1000)).alias("most"))
        closest = at.join(small(near, 2 * n_groups, BROADCAST_GROUPS), ["g", "start"]).filter("distance <= most")
        made = _inverted(_moments(closest, "g", "start", also=(F.first("old").alias("old"),)))
        before, found = found, store.cut(made.withColumn("moved", F.abs(F.col("log_det") - F.col("old"))).drop("old"))
        moved = found.agg(F.max("moved")).first()[0]
        store.drop(before)
        if moved is None or moved < settled:
            break
    held = [f"m{i}" for i in range(p)] + [f"c{i}_{j}" for i, j in _pairs()] + ["log_det"]
    best = found.groupBy("g").agg(F.min_by(F.struct(*held), F.struct("log_det", "start")).alias("best"))
    return store.cut(best.join(sizes, "g").select("g", "n", "best.*"))


def estimates(rows: DataFrame, store: Scratch) -> DataFrame:
    """(g, m, k) from (g, pool, x): the estimate that each group's rows are judged by.

    A group's centre is its own, drawn to the mean of its language's centres by a share that falls
    with its rows. Its covariance is its own, drawn in the same way to that of its language
    and of all documents, which are estimated after each group's medians are taken off x. So a
    group of any size has an estimate, and the shares change smoothly with n.
    """
    p = len(FEATURES)
    middles = store.cut(rows.groupBy("g", "pool").agg(*[F.percentile_approx(f"x{i}", F.lit(0.5), F.lit(1000)).alias(f"o{i}") for i in range(p)]))
    n_groups = middles.count()
    levels = F.explode(F.array(F.concat(F.lit("own "), "g"), F.concat(F.lit("pool "), "pool"), F.lit("all"))).alias("g")
    centered = rows.join(small(middles.drop("pool"), n_groups, BROADCAST_GROUPS), "g").select(levels, *[(F.col(f"x{i}") - F.col(f"o{i}")).alias(f"x{i}") for i in range(p)])
    found = mcd(store.cut(centered), store)
    part = lambda kind, *names: found.filter(F.startswith("g", F.lit(kind))).selectExpr(f"substring(g, {len(kind) + 1}) AS key", *names)
    own = part("own ", "n", *[f"m{i}" for i in range(p)], *[f"c{i}_{j}" for i, j in _pairs()]).withColumnRenamed("key", "g").join(middles, "g")
    own = own.withColumns({f"m{i}": F.col(f"m{i}") + F.col(f"o{i}") for i in range(p)})
    by_pool = own.groupBy("pool").agg(*[(F.sum(F.col(f"m{i}") * F.col("n")) / F.sum("n")).alias(f"pm{i}") for i in range(p)])
    pooled = part("pool ", "n AS pn", *[f"c{i}_{j} AS p{i}_{j}" for i, j in _pairs()]).withColumnRenamed("key", "pool")
    every = part("all", *[f"c{i}_{j} AS a{i}_{j}" for i, j in _pairs()]).drop("key")
    met = own.join(by_pool, "pool").join(pooled, "pool").join(F.broadcast(every), F.lit(True))  # one row
    share, in_pool, near = f"n / (n + {COVARIANCE_ROWS})", f"pn / (pn + {COVARIANCE_ROWS})", f"n / (n + {CENTER_ROWS})"
    means = [f"{near} * m{i} + (1 - {near}) * pm{i} AS m{i}" for i in range(p)]
    spreads = [f"{share} * c{i}_{j} + (1 - {share}) * ({in_pool} * p{i}_{j} + (1 - {in_pool}) * a{i}_{j}) AS c{i}_{j}" for i, j in _pairs()]
    return store.cut(_inverted(met.selectExpr("g", *means, *spreads)).select("g", *[f"m{i}" for i in range(p)], *[f"k{i}_{j}" for i, j in _pairs()]))


def outlier_distances(stats: DataFrame, store: Scratch, lang: str = "lang", source: str = "source") -> DataFrame:
    """``stats`` plus the double ``distance``: the squared Mahalanobis distance of a row's
    transformed statistics from the estimate (see ``estimates``) of its language and source. A
    null language or source is a group of its own."""
    p = len(FEATURES)
    group = F.to_json(F.struct(F.col(lang).cast("string").alias("a"), F.col(source).cast("string").alias("b")))
    pool = F.to_json(F.struct(F.col(lang).cast("string").alias("a")))
    rows = stats.withColumns({"g": group, "pool": pool}).withColumns({f"x{i}": F.expr(e) for i, (e, _) in enumerate(FEATURES.values())})
    narrow = store.cut(rows.select("g", "pool", *[f"x{i}" for i in range(p)]))
    found = estimates(narrow, store)
    store.drop(narrow)
    return rows.join(small(found, found.count(), BROADCAST_GROUPS), "g", "left").withColumn("distance", _distance()).drop("g", "pool", *[f"x{i}" for i in range(p)], *[c for c in found.columns if c != "g"])


def quality_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The ``keep`` columns, the base statistics, ``base_failed``, ``distance`` and ``kept``.

    A document fails the base rules if it has fewer than 20 words, or more than 30 words of
    100 in repeated 8-word windows; those are never kept and take no part in the estimates. The
    others are kept if their distance (see ``outlier_distances``) is at most ``cutoff``. Null and
    empty texts have no words and fail; a document whose distance can't be computed is kept.
    Repeated rows count each on its own. Only the named columns are read, so others can't clash.
    """
    store = Scratch(docs.sparkSession)
    taken = docs.select(*[F.col(c).alias(f"keep__{i}") for i, c in enumerate(keep)], F.col(text).alias("text"), F.col(lang).alias("lang__"), F.col(source).alias("source__"))
    stats = statistics(taken).drop("text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = store.cut(stats.withColumn("base_failed", failed))
    judged = outlier_distances(stats.filter("NOT base_failed"), store, "lang__", "source__")
    both = judged.unionByName(stats.filter("base_failed"), allowMissingColumns=True)
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    return both.select(*[F.col(f"keep__{i}").alias(c) for i, c in enumerate(keep)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "base_failed", "distance", kept.alias("kept"))
