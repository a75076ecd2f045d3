"""Overlap filters of intervals of all lengths, cut-off selection, and negatives from a genome, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import expand, genome, intervals as I, matrix as M, selection

ROWS = "chrom string, start long, end long"


def some(rng, n, most):
    out = []
    for _ in range(n):
        start, size = rng.randrange(0, 300_000_000), int(10 ** rng.uniform(0, most))
        out.append((f"chr{rng.randint(1, 2)}", start, start + size))
    return out


@pytest.mark.parametrize("method, window, invert", [("any", 0, False), ("any", 700, True), ("all", 0, False)])
def test_overlaps_of_intervals_of_all_lengths(spark, method, window, invert):
    rng = random.Random(3)
    left = some(rng, 400, 8) + some(rng, 10, 3) * 2 + [("chr1", 0, 280_000_000), ("chr2", 5, 5), ("chr1", 2048, 4096), ("chr1", 4096, 4097)]
    right = some(rng, 40, 6.5) + [("chr2", 100_000_000, 140_000_000), ("chr1", 4095, 4096), ("chr1", 9, 9)]

    def hit(a):
        inside = [b for b in right if a[0] == b[0]]
        if method == "all":
            return any(a[1] >= b[1] - window and a[2] <= b[2] + window for b in inside)
        return any(a[1] < b[2] + window and a[2] > b[1] - window for b in inside)

    df, ref = spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS)
    made = I.filter_overlapping(df, ref, window, invert, method)
    assert sorted(map(tuple, made.collect())) == sorted(a for a in left if hit(a) != invert)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Generate") == 1  # the reference's


def test_one_interval_over_a_chromosome(spark):
    df = spark.range(20_000).select(F.lit("chr1").alias("chrom"), (F.col("id") * 10_000).alias("start"), (F.col("id") * 10_000 + 300).alias("end"))
    ref = spark.createDataFrame([("chr1", 5_000, 150_000_000)], ROWS)
    assert I.filter_overlapping(df, ref).count() == 14_999 and I.filter_overlapping(ref, df).count() == 1


def test_first_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.0, -1.5, 3.0, rng.gauss(0, 100)]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, value double, g string")
    for n in (0, 1, 37, 499, 500, 900):
        made = selection.first_n(df, n, -selection.value_bucket(F.col("value")), F.desc("value"), F.col("id"))
        assert sorted(r["id"] for r in made.collect()) == sorted(r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:n])
    draw = lambda i: int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16)
    want = sorted(r[0] for r in sorted(rows, key=lambda r: draw(r[0]))[:60])
    assert sorted(r["id"] for r in I.sample_n(df, 60, seed=7).collect()) == want == sorted(r["id"] for r in I.sample_n(df.repartition(9), 60, seed=7).collect())
    order = selection.hashed_order(7, "id")
    each = selection.first_n(df, F.when(F.col("g") == "a", 5).otherwise(900), selection.drawn_bucket(order), order, by="g").collect()
    assert sorted(r["id"] for r in each if r["g"] == "a") == sorted(r[0] for r in sorted([r for r in rows if r[2] == "a"], key=lambda r: draw(r[0]))[:5])
    assert sum(r["g"] == "b" for r in each) == sum(r[2] == "b" for r in rows)
    assert selection.first_n(df.limit(0), 5, F.col("id"), F.col("id")).count() == 0


def test_top_totals_with_ties(spark):
    m = spark.createDataFrame([(1, v, float(v % 7)) for v in range(1, 200)], "obs long, var long, value double")
    got = sorted(r["var"] for r in M.filter_coverage(m, 1, "top", 40).collect())
    assert got == sorted(sorted(range(1, 200), key=lambda v: (-(v % 7), v))[:40])


def test_negatives_from_a_genome(spark):
    rng = random.Random(5)
    letters = {f"chr{i}": "".join(rng.choice("ACGT" if j % 900 < 500 else "GCGCA") for j in range(rng.randint(3_000, 5_000))) for i in (1, 2, 3)}
    chunks = genome.genome_chunks(spark.createDataFrame(list(letters.items()), "name string, seq string"), 128)
    tiles = {(r["chrom"], r["start"]): r["n_gc"] for r in genome.tiled_counts(chunks, 50, 128).collect()}
    gc = lambda c, s: sum(x in "GC" for x in letters[c][s : s + 50])
    assert tiles == {(c, s): gc(c, s) for c, x in letters.items() for s in range(0, len(x) - 49, 50)}
    own = [(i, f"chr{rng.randint(1, 3)}", rng.randrange(2_900)) for i in range(30)]
    inputs = spark.createDataFrame([(i, c, s, s + 50) for i, c, s in own] + [(99, "chr1", 4_999, 5_049)], "id long, chrom string, start long, end long")
    assert I.unique_length(inputs) == 50
    black = spark.createDataFrame([("chr1", 1_000, 2_000)], ROWS)
    made = expand.genome_negatives(inputs, chunks, 50, 0.1, 2, black, ["chr1", "chr2"], 128).collect()
    bin_of = lambda n: max(i for i in range(10) if i * 0.1 <= n / 50)
    want = {}
    for _, c, s in own:
        want[bin_of(gc(c, s))] = want.get(bin_of(gc(c, s)), 0) + 1
    free = [(c, s) for c, s in tiles if c != "chr3" and not any(c == d and s < e + 50 and s + 50 > e for _, d, e in own) and not (c == "chr1" and s < 2_000 and s + 50 > 1_000)]
    have = {}
    for c, s in free:
        have.setdefault(bin_of(gc(c, s)), set()).add((c, s))
    got = {}
    for r in made:
        got.setdefault(r["bin"], set()).add((r["chrom"], r["start"]))
    assert all(got[b] <= have[b] for b in got)
    assert {b: len(x) for b, x in got.items()} == {b: min(n, len(have[b])) for b, n in want.items() if have.get(b)}
    with pytest.raises(ValueError):
        I.unique_length(inputs.unionByName(spark.createDataFrame([(1, "chr1", 0, 9)], inputs.schema)))
