"""Registered queries with a scorer to which the order of letters matters, designs over all starts, table functions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import tables
from helixframe.operators import expand, kmers, scoring
from helixframe.plans import tables as T
from helixframe.plans.queries import TASKS, _score_sql, query, six

#: Weights of 3-letter windows by rule: (factor, offset, modulus, scale, shift).
RULES = {"k1": (7, 3, 11, 3.7, 1.0), "k2": (5, 1, 13, 3.0, 1.5)}
WEIGHTS = {t: [(c * f + o) % m / scale - shift for c in range(64)] for t, (f, o, m, scale, shift) in RULES.items()}


def _total(seq: str, task: str) -> str:
    """Sum of the weights of all windows of ``seq``, in SQL."""
    f, o, m, scale, shift = RULES[task]
    letter = lambda i: f"(strpos('ACGT', {seq}[i+{i}])-1)"
    return f"coalesce(list_sum(list_transform(range(1, length({seq})-1), lambda i: ((({letter(0)}*16+{letter(1)}*4+{letter(2)})*{f}+{o})%{m})/{scale}::double-{shift}::double)), 0.0)"


def _mean(seq: str, task: str) -> str:
    return f"({_total(seq, task)}/(length({seq})-2))"


@query("kmer_scores", " UNION ALL ".join(f"SELECT id, '{t}' AS task, round({_mean('seq', t)}, 6) AS value FROM sequences WHERE length(seq) >= 3" for t in RULES), "sequences")
def kmer_scores(spark, d):
    return scoring.score_by(T.sequences(spark, d).select("id", "seq").filter(F.length("seq") >= 3), kmers.scorer(WEIGHTS)).withColumn("value", six("value"))


@query("kmer_ism", f"""SELECT id, p-1 AS pos, b AS base, round(({_total('m', 'k1')} - {_total('o', 'k1')})/(n-2), 6) + 0.0 AS effect FROM (
 SELECT id, p, b, n, substring(seq, lo, p-lo) || b || substring(seq, p+1, 2) AS m, substring(seq, lo, p+3-lo) AS o FROM (
 SELECT id, seq, length(seq) AS n, p, greatest(p-2, 1) AS lo FROM (SELECT *, unnest(range(1, length(seq)+1)) AS p FROM sequences WHERE length(seq) >= 3)), (VALUES ('A'),('C'),('G'),('T')) v(b))""", "sequences")  # fmt: skip
def kmer_ism(spark, d):
    made = kmers.ism_scores(T.sequences(spark, d).select("id", "seq"), {"k1": WEIGHTS["k1"]})
    return made.select("id", F.col("pos").cast("long").alias("pos"), "base", (six("effect") + 0.0).alias("effect"))


#: Backgrounds that SQL can make too: a sequence turned by 0, 7, 14, 21 and 28 letters.
TURNS = 5
_TURNED = "SELECT id, seq, substring(seq, r*7+1) || substring(seq, 1, r*7) AS t, r FROM sequences, range(0, 5) g(r) WHERE length(seq) >= 8"


def _turned(spark, d) -> DataFrame:
    seqs = T.sequences(spark, d).select("id", "seq").filter(F.length("seq") >= 8).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))))
    return seqs.withColumn("seq", F.concat(F.substring(F.col("seq"), F.col("r") * 7 + 1, F.length("seq")), F.substring(F.col("seq"), F.lit(1), F.col("r") * 7)))


def _written(seq: str, allele: str, n: int) -> str:
    """``allele`` of n letters in the middle of ``seq``."""
    at = f"((length({seq})-{n})//2)"
    return f"(substring({seq}, 1, {at}) || {allele} || substring({seq}, {at}+{n + 1}))"


_ALLELE = "substring('ACGT', CAST({x}%4+1 AS bigint), 1)"


@query("variant_significance_in_context", f"""SELECT id, task, n, round(m, 6) + 0.0 AS background_mean, round(s, 6) AS background_sd, CASE WHEN s > 1e-9 THEN round((e-m)/s, 4) + 0.0 END AS z FROM (
 SELECT id, task, count(*) AS n, avg(e) AS m, stddev_pop(e) AS s, max(e) FILTER (r = 0) AS e FROM (
 {" UNION ALL ".join(f"SELECT id, r, '{t}' AS task, {_mean('a', t)} - {_mean('b', t)} AS e FROM (SELECT id, r, {_written('t', _ALLELE.format(x='(id+1)'), 1)} AS a, {_written('t', _ALLELE.format(x='id'), 1)} AS b FROM ({_TURNED}))" for t in RULES)}) GROUP BY id, task)""", "sequences")  # fmt: skip
def variant_significance_in_context(spark, d):
    letter = lambda shift: F.substring(F.lit("ACGT"), (F.pmod(F.col("id") + shift, F.lit(4)) + 1).cast("int"), F.lit(1))
    rows = _turned(spark, d).withColumn("ref", letter(0)).withColumn("alt", letter(1))
    score = kmers.scorer(WEIGHTS)
    own = scoring.variant_moments(rows.filter("r = 0"), score).select("id", "task", F.col("background_mean").alias("effect"))
    made = scoring.against_moments(own, scoring.variant_moments(rows, score))
    z = F.when(F.col("background_sd") > 1e-9, F.round("z", 4) + 0.0)
    return made.select("id", "task", "n", (six("background_mean") + 0.0).alias("background_mean"), six("background_sd").alias("background_sd"), z.alias("z"))


@query("pattern_effects_in_context", f"""SELECT id, pattern, 'k1' AS task, count(*) AS n, round(avg(e), 6) + 0.0 AS background_mean, round(stddev_pop(e), 6) AS background_sd FROM (
 {" UNION ALL ".join(f"SELECT id, '{p}' AS pattern, {_mean('a', 'k1')} - {_mean('t', 'k1')} AS e FROM (SELECT id, t, {_written('t', repr(p), len(p))} AS a FROM ({_TURNED}))" for p in ("CACGTG", "TTGCGTG"))}) GROUP BY id, pattern""", "sequences")  # fmt: skip
def pattern_effects_in_context(spark, d):
    made = scoring.pattern_moments(_turned(spark, d), ["CACGTG", "TTGCGTG"], kmers.scorer({"k1": WEIGHTS["k1"]}))
    return made.select("id", "pattern", "task", "n", (six("background_mean") + 0.0).alias("background_mean"), six("background_sd").alias("background_sd"))


@query("shuffled_tile_effects")
def shuffled_tile_effects(spark, d):
    seqs = T.sequences(spark, d).select("id", "seq", F.col("seq").alias("own"))
    shuffled = expand.tile_shuffles(seqs, 50, F.length("seq"), 25, 6, 3, 2)
    return scoring.tile_moments(shuffled, None, kmers.scorer(WEIGHTS)).withColumns({c: six(c) for c in ("background_mean", "background_sd")})


@query("significance_against_shuffles")
def significance_against_shuffles(spark, d):
    """Each window's variant against 20 shuffles of its window: no row of a shuffle leaves its stage."""
    seqs = T.sequences(spark, d).filter(F.length("seq") >= 25)
    windows = seqs.select("id", F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.substring(F.col("seq"), F.floor(F.length("seq") / 2).cast("int") - 11, F.lit(25)).alias("seq"))
    score = kmers.scorer({"k1": WEIGHTS["k1"]})
    own = scoring.variant_moments(windows, score).select("id", "task", F.col("background_mean").alias("effect"))
    made = scoring.against_moments(own, scoring.variant_moments(expand.dinuc_shuffle(windows, 20, 3), score))
    return made.select("id", "task", "n", *[six(c).alias(c) for c in ("effect", "background_mean", "background_sd", "z", "p_value")])


def _round(i: int) -> str:
    return f"""m{i} AS (SELECT r.id, p-1 AS pos, b AS allele, substring(seq,1,p-1) || b || substring(seq,p+4) AS seq FROM (SELECT *, unnest(range(1, length(seq)-2)) AS p FROM r{i - 1} WHERE length(seq) >= 4) r, (VALUES ('GGGG'),('TTCT')) v(b)),
 r{i} AS (SELECT {i} AS iter, id, pos, allele, seq, {_score_sql('seq', 't1')} AS total_score FROM m{i} ORDER BY total_score DESC, id, pos, allele LIMIT 1)"""


@query("evolved_together", f", r0 AS (SELECT 0 AS iter, id, -1 AS pos, '' AS allele, seq, {_score_sql('seq', 't1')} AS total_score FROM sequences WHERE length(seq) >= 4 ORDER BY total_score DESC, id LIMIT 1), {', '.join(_round(i) for i in (1, 2, 3, 4))} SELECT cast(iter AS bigint) AS iter, id, cast(pos AS bigint) AS pos, allele, seq, round(total_score, 6) AS total_score FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 WHERE (SELECT max(total_score) FROM r1) > (SELECT max(total_score) FROM r0) UNION ALL SELECT * FROM r3 WHERE (SELECT max(total_score) FROM r2) > (SELECT max(total_score) FROM r1) AND (SELECT max(total_score) FROM r1) > (SELECT max(total_score) FROM r0) UNION ALL SELECT * FROM r4 WHERE (SELECT max(total_score) FROM r3) > (SELECT max(total_score) FROM r2) AND (SELECT max(total_score) FROM r2) > (SELECT max(total_score) FROM r1) AND (SELECT max(total_score) FROM r1) > (SELECT max(total_score) FROM r0))", "sequences")
def evolved_together(spark, d):
    seqs = T.sequences(spark, d).select("id", "seq").filter(F.length("seq") >= 4)
    made = scoring.evolve(seqs, TASKS["t1"], "pattern", ["GGGG", "TTCT"], max_iter=4, for_each=False).filter("best_in_iter")
    return made.select(F.col("iter").cast("long").alias("iter"), "id", F.col("pos").cast("long").alias("pos"), "allele", "seq", six("total_score").alias("total_score"))


@query("tiles_in_sql", "SELECT id, cast(k*25 AS integer) AS tile_start, substring(seq, k*25+1, 50) AS tile FROM (SELECT *, unnest(range(0, (length(seq)-50)//25+1)) AS k FROM sequences WHERE length(seq) >= 50)", "sequences")
def tiles_in_sql(spark, d):
    tables.register(spark)
    return spark.sql("SELECT id, t.tile_start, t.tile FROM {seqs}, LATERAL sequence_tiles(seq, 50, 25) t", seqs=T.sequences(spark, d))
