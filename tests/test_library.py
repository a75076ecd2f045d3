"""Operators against literal inputs with exact results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import coverage, expand, genome, intervals as I, matrix as M, metrics, motifs, scoring, variants as V
from helixframe.plans import tables as T
from helixframe.schema import require_columns


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sequence_expressions(spark):
    s = F.lit
    assert one(spark, S.reverse_complement(s("ACCTN")), S.gc_fraction(s("GCAN")), S.valid_dna(s("ACGTN")), S.valid_dna(s("AZ"))) == ["NAGGT", 0.5, True, False]
    assert one(spark, S.pad(s("AA"), 5), S.pad(s("AA"), 5, "left"), S.pad(s("AA"), 5, "right")) == ["NAANN", "NNNAA", "AANNN"]
    assert one(spark, S.trim(s("ACGTA"), 2), S.trim(s("ACGTA"), 2, "left"), S.trim(s("ACGTA"), 2, "right"), S.resize(s("A"), 3)) == ["CG", "TA", "AC", "NAN"]
    assert one(spark, S.insert(s("AGT"), s("CCC"), 1), S.insert(s("AGAAT"), s("CCC")), S.insert(s("AGAAT"), s("CCC"), None, True), S.insert(s("AG"), s("C"), 0)) == ["ACCCGT", "AGCCCAAT", "GCCCA", "CAG"]
    assert one(spark, S.delete(s("AGT"), 1, 2), S.delete(s("AGAAT"), 2), S.delete(s("AGAAT"), 2, None, True)) == ["AG", "AAT", "NAATN"]
    assert one(spark, S.mutate(s("AGT"), s("A"), 2), S.mutate(s("AGT"), s("A")), S.mutate(s("AGT"), s("CC"))) == ["AGA", "AAT", "CCT"]
    assert one(spark, S.count_overlapping(s("AAAA"), "AA"), S.pattern_score(s("AAATT"), ["AA", "TT"], [1, -0.5]), S.encode(s("ACGTN")), S.decode(F.array(*map(s, (3, 0, 4))))) == [3, 1.5, [0, 1, 2, 3, 4], "TAN"]
    assert one(spark, S.differences(s("ACGT"), s("AGGA")), S.encode(s("")), S.compare(s(8.0), s(2.0), "log2FC"), S.compare(s(1.0), s(0.0), "divide")) == [[1, 3], [], 2.0, None]
    assert one(spark, S.label_transform(s(150.0), 0, 100, "log"))[0] == pytest.approx(math.log(100))
    with pytest.raises(ValueError):
        S.pad(s("A"), 3, "middle")


def frame(spark, items, schema="id long, chrom string, start long, end long"):
    return spark.createDataFrame(items, schema)


def test_range_joins(spark):
    df = frame(spark, [(0, "chr1", 100, 200), (1, "chr1", 1990, 2010), (2, "chr2", 0, 50), (3, "chr1", 6000, 12000)])
    ref = spark.createDataFrame([("chr1", 150, 400), ("chr1", 1900, 2100), ("chr1", 7000, 7010), ("chr1", 11000, 11500)], "chrom string, start long, end long")
    assert [r[0] for r in rows(I.filter_overlapping(df, ref), "id")] == [0, 1, 3]
    assert [r[0] for r in rows(I.filter_overlapping(df, ref, method="all"), "id")] == [1]
    assert [r[0] for r in rows(I.filter_blacklist(df, ref), "id")] == [2]
    assert I.overlap_pairs(df, ref).count() == 4
    assert I.filter_overlapping(df, ref.limit(0)).count() == 0


def test_range_join_matches_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n: [(i, f"chr{rng.randrange(3)}", s := rng.randrange(20_000), s + rng.randrange(1, 5000)) for i in range(n)]
    a, b = make(80), make(60)
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}
    got = I.overlap_pairs(frame(spark, a), frame(spark, b).withColumnRenamed("id", "ref"), carry=("ref",))
    assert sorted((r["id"], r["ref"]) for r in got.collect()) == sorted(want)


def test_interval_maps(spark):
    df = frame(spark, [(0, "chr1", 15000, 15003), (1, "chr1", 15010, 15013)])
    assert [r[2:] for r in rows(I.resize_intervals(df, 8), "id")] == [(14998, 15006), (15008, 15016)]
    ends = frame(spark, [(0, "chr1", -1, 10), (1, "chr1", 0, 100), (2, "chr1", 5, 101), (3, "chrU", 5, 1000)])
    sizes = spark.createDataFrame([("chr1", 100)], "chrom string, size long")
    assert [r[0] for r in rows(I.filter_chrom_ends(ends, sizes), "id")] == [1, 3]
    assert [r[0] for r in rows(I.check_chrom_ends(ends, sizes), "id")] == [0, 2]
    assert [r["tile_start"] for r in I.tile_positions(spark.range(1), 30, 3, 3, 3).collect()] == [0, 3, 6, 9, 18, 21, 24, 27]
    genes = spark.createDataFrame([("chr1", 1, 5, "+", "a"), ("chr1", 3, 9, "+", "a"), ("chr1", 1, 2, "+", "b"), ("chr2", 1, 2, "+", "b")], "chrom string, start long, end long, strand string, gene string")
    merged, odd = I.merge_intervals_by_column(genes, "gene")
    assert rows(merged, "gene") == [("chr1", 1, 9, "+", "a")] and rows(odd, "gene") == [("b",)]
    assert {r["split"] for r in I.split(frame(spark, [(0, "chr10", 1, 2), (1, "chr11", 1, 2), (2, "chr1", 1, 2)])).collect()} == {"val", "test", "train"}
    assert I.sample_n(spark.range(100), 7).count() == 7
    assert sorted(r[0] for r in I.sample_n(spark.range(100), 7).collect()) == sorted(r[0] for r in I.sample_n(spark.range(100).repartition(9), 7).collect())
    with pytest.raises(ValueError, match="chrom"):
        require_columns(spark.range(1), "chrom")


def test_variants(spark):
    v = spark.createDataFrame([(0, "chr1", 5, "A", "C"), (1, "chr1", 5, "AT", "-"), (2, "chr1", 5, "N", "C"), (3, "chr1", 5, "A", "AGG")], "id long, chrom string, pos long, ref string, alt string")
    assert [r[0] for r in rows(V.filter_variants(v), "id")] == [0]
    assert [r[0] for r in rows(V.filter_variants(v, max_insert_len=2, max_del_len=None), "id")] == [0, 1, 3]
    assert [r[0] for r in rows(V.filter_variants(v, False, None, None), "id")] == [0, 1, 2, 3]
    said = spark.createDataFrame([("G>A,C,T",)], "v string")
    assert rows(V.split_variant_string(said, "v").select("ref", "alt"), "alt") == [("G", "A")]
    assert len(rows(V.split_variant_string(said, "v", True), "alt")) == 3


def test_genome_over_chunk_edges(spark):
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(300))
    chunks = genome.genome_chunks(spark.createDataFrame([("c", seq)], "name string, seq string"), 16)
    df = spark.createDataFrame([(i, "c", i * 7, i * 7 + 40, "-" if i % 2 else "+") for i in range(30)], "id long, chrom string, start long, end long, strand string")
    turn = str.maketrans("ACGT", "TGCA")
    for r in genome.intervals_to_sequences(df, chunks, 16).collect():
        own = seq[r["id"] * 7 : r["id"] * 7 + 40]
        assert r["seq"] == (own.translate(turn)[::-1] if r["id"] % 2 else own)


def test_coverage(spark):
    frags = spark.createDataFrame([("chr1", 0, 3), ("chr1", 1, 3), ("chr1", 0, 2), ("chr10", 0, 9)], "chrom string, start long, end long")
    counts = coverage.insertion_counts(frags, chroms=["chr1"])
    assert rows(counts, "pos") == [("chr1", 0, 2), ("chr1", 1, 2), ("chr1", 2, 2)]
    for span in (1, 2, 1000):
        assert rows(coverage.merge_runs(counts, span), "start") == [("chr1", 0, 3, 2)]
    at = frame(spark, [(0, "chr1", 1, 10), (1, "chr2", 0, 5)])
    assert rows(coverage.coverage_over_intervals(at, coverage.merge_runs(counts), "mean"), "id") == [(0, 4 / 9), (1, 0.0)]


def test_matrix(spark):
    m = spark.createDataFrame([("a", "v1", 4.0), ("b", "v1", 2.0), ("a", "v2", 1.0), ("b", "v3", 9.0)], "obs string, var string, value double")
    assert rows(M.filter_coverage(m, 2, "cutoff", 1).select("var", "total"), "var") == [("v1", 3.0), ("v3", 4.5)]
    assert rows(M.filter_coverage(m, 2, "top", 1).select("var"), "var") == [("v3",)]
    assert rows(M.var_totals(m, 2, "min"), "var") == [("v1", 2.0), ("v2", 0.0), ("v3", 0.0)]
    assert M.filter_coverage(m, 2, "cutoff", 1, negative_frac=0.5).filter("is_negative").count() == 1


def test_motif_scan(spark):
    seqs = spark.createDataFrame(list(enumerate(["TCACGTGAA", "CACGCAGGA", "CCTGCGTGA", "NNN", "A", None])), "id long, seq string")
    m = T.motifs(spark)
    got = rows(motifs.scan_motifs(seqs, m), "motif", "id", "strand")
    arnt, ahr = T.MOTIFS
    assert [r[:5] + (r[7],) for r in got] == [(0, arnt, 1, 7, "+", "CACGTG"), (0, arnt, 1, 7, "-", "CACGTG"), (1, ahr, 0, 6, "-", "CACGCA"), (2, ahr, 2, 8, "+", "TGCGTG")]
    assert [r[5] for r in got] == pytest.approx([11.60498, 11.60498, 10.69132, 10.69132], abs=1e-4)
    assert [r[6] for r in got] == [1 / 4096] * 4
    assert motifs.scan_motifs(seqs, m, rc=False).count() == 2
    assert rows(motifs.consensus(m), "motif") == [(arnt, "CACGTG"), (ahr, "TGCGTG")]


def test_compared_motifs(spark):
    pair = spark.createDataFrame([(1, "CACGTGACGCATGA", "TAAGTGACGCGTGA")], "id long, ref_seq string, alt_seq string")
    got = rows(motifs.compare_motifs(pair, T.motifs(spark), 5e-4, False).select("start", "p_alt", "p_ref", "score_alt", "score_ref", "score_diff"), "score_diff")
    assert [r[0] for r in got] == [0, 7]
    assert got[0][1:] == pytest.approx((0.015625, 1 / 4096, -14.64884, 11.60498, -26.25382), abs=1e-4)
    assert got[1][1:] == pytest.approx((1 / 4096, 0.010009766, 10.23201, -2.99446, 13.22646), abs=1e-4)


def test_motif_tables(spark):
    m = T.motifs(spark)
    assert motifs.trim_motif(m.withColumn("prob", F.when(F.col("pos") == 0, 0.0).otherwise(F.col("prob")))).groupBy("motif").agg(F.max("pos").alias("p")).agg(F.max("p")).first()[0] == 4
    alike = motifs.motif_similarity(m, m)
    best = {r["query"]: r["target"] for r in motifs.top_matches(alike, 1).collect()}
    assert best == {k: k for k in T.MOTIFS}
    q = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 0.04), ("a", 0.5)], "g string, p double")
    assert [r["q_value"] for r in motifs.fdr_bh(q, "p", "g").orderBy("p").collect()] == pytest.approx([0.04, 0.04, 0.04 * 4 / 3, 0.5])


def test_expansions(spark):
    seqs = spark.createDataFrame([(1, "AAGACATACAACGCGCGCTAACATAGCAAC")], "id long, seq string")
    pairs = lambda s: sorted(s[i : i + 2] for i in range(len(s) - 1))
    made = [r["seq"] for r in expand.dinuc_shuffle(seqs, 5, 1).collect()]
    assert all(pairs(s) == pairs("AAGACATACAACGCGCGCTAACATAGCAAC") and s[0] == "A" and s[-1] == "C" for s in made) and len(set(made)) > 1
    assert sorted(made) == sorted(r["seq"] for r in expand.dinuc_shuffle(seqs.repartition(3), 5, 1).collect())
    short = spark.createDataFrame([(1, "ACG")], "id long, seq string")
    assert sorted(r["seq"] for r in expand.saturation_mutants(short, [1], True).collect()) == ["AAG", "AGG", "ATG"]
    assert expand.saturation_mutants(short).count() == 12
    assert sorted(r["seq"] for r in expand.pattern_scan(short, ["TT", "C"]).collect()) == ["ACG", "ATT", "CCG", "TTG"]
    assert sorted(r["seq"] for r in expand.augment(short, 1, True, 1).collect()) == ["A", "C", "C", "G", "G", "T"]
    assert expand.tile_shuffles(seqs, 10, 30, 5, 4, 2).count() == 2 * len([s for s in range(0, 21, 5) if s + 10 <= 13 or s >= 17])
    mutants = expand.random_mutants(short, protect=[0, 1]).collect()
    assert all(r["pos"] == 2 and r["seq"][:2] == "AC" and r["seq"][2] != "G" for r in mutants)
    assert expand.random_sequences(spark, 5, 4).filter("seq rlike '^[ACGT]{5}$'").count() == 4



def test_metrics(spark):
    p = spark.createDataFrame([(0, "a", 0.9, 1), (1, "a", 0.8, 0), (2, "a", 0.7, 1), (0, "b", 0.5, 0), (1, "b", 0.5, 1), (2, "b", 0.5, 0)], "id long, task string, pred double, label int")
    assert rows(metrics.best_f1(p), "task") == [("a", pytest.approx(0.8)), ("b", pytest.approx(0.5))]
    assert rows(metrics.average_precision(p), "task") == [("a", pytest.approx(5 / 6)), ("b", pytest.approx(1 / 3))]
    assert rows(metrics.auroc(p), "task") == [("a", 0.5), ("b", 0.5)]
    assert rows(metrics.accuracy(p), "task") == [("a", pytest.approx(2 / 3)), ("b", pytest.approx(2 / 3))]
    assert metrics.evaluation_loss(p, "mse").first()[0] == pytest.approx((0.01 + 0.64 + 0.09 + 0.75) / 6)
    bce = metrics.evaluation_loss(spark.createDataFrame([(0, "a", 0.0, 1)], "id long, task string, pred double, label int"), "bce", {"a": 10}).first()[0]
    assert bce == pytest.approx(10 * math.log(2))
    assert {r["bin"]: r["n"] for r in metrics.gc_distribution(spark.createDataFrame([(1, "GCA"), (2, "GGG")], "id long, seq string")).collect()}[9] == 1


def test_predictions(spark):
    p = spark.createDataFrame([(1, "a", 1, 0.2), (1, "a", 2, 1.0), (1, "b", 1, -1.0), (1, "b", 2, 10.0)], "id long, task string, pos int, value double")
    got = scoring.specificity(p, ["a"], ["b"], off="max", off_weight=2, off_thresh=1).first()["specificity"]
    assert got == pytest.approx(1.2 / 18)
    assert scoring.aggregate_predictions(p, task="sum", positions=[2]).first()["value"] == 11
    assert rows(scoring.activation(p, "softmax").groupBy("pos").agg(F.sum("value").alias("s")), "pos") == [(1, pytest.approx(1)), (2, pytest.approx(1))]
    flipped = p.withColumn("pos", F.col("pos") - 1).withColumn("rc", F.lit(True))
    assert rows(scoring.average_augmented(flipped, ["id"], 2).filter("task = 'a'").select("pos", "value"), "pos") == [(0, 1.0), (1, 0.2)]
    seqs = spark.createDataFrame([(1, "AAA"), (2, "CAT")], "id long, seq string")
    best = scoring.evolve(seqs, {"A": 0.0, "C": 1.0, "G": 0.0, "T": 0.0}, max_iter=5).filter("best_in_iter").groupBy("id").agg(F.max("total_score").alias("s"), F.max("iter").alias("i"))
    assert rows(best, "id") == [(1, 1.0, 3), (2, 1.0, 3)]

    def load():
        import pandas as pd

        return lambda texts: pd.DataFrame({"row": range(len(texts)), "task": "n", "value": [float(len(t)) for t in texts]})

    assert rows(scoring.score_sequences(seqs, load), "id") == [(1, "n", 3.0), (2, "n", 3.0)]


def test_quantiles_and_q_values_match_plain_python(spark):
    rng = random.Random(4)
    data = [(g, rng.choice([0.5, rng.random(), rng.random() ** 9])) for g in "ab" for _ in range(150)] + [("one", 0.25)]
    df = spark.createDataFrame(data, "g string, p double")
    box = {r["g"]: r for r in metrics.box_statistics(df, "p", "g").collect()}
    for g in ("a", "b", "one"):
        own = sorted(p for k, p in data if k == g)
        for name, share in (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1)):
            at = (len(own) - 1) * share
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert box[g][name] == pytest.approx(low + (high - low) * (at - math.floor(at)))
    got = sorted((r["g"], r["p"], r["q_value"]) for r in motifs.fdr_bh(df, "p", "g").collect())
    want = []
    for g in ("a", "b", "one"):
        own = sorted(p for k, p in data if k == g)
        raw = {p: p * len(own) / sum(x <= p for x in own) for p in own}
        want += [(g, p, min(1.0, min(v for k, v in raw.items() if k >= p))) for p in own]
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_normal_tail_and_t_quantiles(spark):
    z = [0.0, 0.3, -1.0, 1.96, 3.4, 3.6, 6.0, -9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(scoring.two_sided(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], rel=1e-9)
    assert one(spark, *[metrics.t_quantile(F.lit(n)) for n in (0, 1, 6, 7, 10, 30, 1000)]) == [None, *map(lambda x: pytest.approx(x, abs=1e-3), (12.7062, 2.4469, 2.3646, 2.2281, 2.0423, 1.9623))]


def test_user_functions(spark):
    p = spark.createDataFrame([(1, "a", 1, 2.0), (1, "a", 2, 5.0), (1, "b", 1, 1.0)], "id long, task string, pos int, value double")
    assert scoring.aggregate_predictions(p, length=lambda v: F.max(v) - F.min(v), task="sum").first()["value"] == 3.0
    assert one(spark, S.compare(F.lit(2.0), F.lit(3.0), lambda a, b: a * b), S.label_transform(F.lit(4.0), how=F.sqrt)) == [6.0, 2.0]
    seqs = spark.createDataFrame([(1, "AAA")], "id long, seq string")
    model = lambda df: scoring.with_scores(df, lambda: lambda texts: [float(t.count("G")) for t in texts])
    best = scoring.evolve(seqs, model, max_iter=2).filter("best_in_iter").orderBy("iter").collect()
    assert [(r["seq"], r["total_score"]) for r in best] == [("AAA", 0.0), ("GAA", 1.0), ("GGA", 2.0)]


def test_substitutions_score_as_whole_strings(spark):
    seqs = spark.createDataFrame([(1, "ACGTNA"), (2, ""), (3, "T")], "id long, seq string")
    tasks = {"t": {"A": 0.3, "C": 1.1, "G": -2.0, "T": 0.7}}
    got = {(r["id"], r["pos"], r["base"]): r["value"] for r in scoring.substitution_scores(seqs, tasks).collect()}
    made = expand.saturation_mutants(seqs.filter("seq <> ''")).withColumn("v", scoring.linear_score(F.col("seq"), tasks["t"]))
    assert got == {(r["id"], r["pos"], r["base"]): r["v"] for r in made.collect()} and len(got) == 28


def test_mutants_are_written_small(spark, tmp_path):
    letters = random.Random(3)
    seqs = spark.createDataFrame([(i, "".join(letters.choices("ACGT", k=n))) for i, n in enumerate([200] * 20 + [301, 1])], "id long, seq string").coalesce(1)
    made = expand.saturation_mutants(seqs, drop_ref=True)
    made.write.parquet(f"{tmp_path}/made")
    made.sortWithinPartitions("id", "pos", "base").write.parquet(f"{tmp_path}/sorted")
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).glob("*.parquet")) for k in ("made", "sorted")}
    assert size["made"] < 0.96 * size["sorted"]
    assert rows(made, "id", "pos", "base") == [(i, s[:p] + b + s[p + 1 :], p, b) for i, s in rows(seqs, "id") for p in range(len(s)) for b in "ACGT" if b != s[p]]


def test_drawn_consensus_and_order(spark):
    m = spark.createDataFrame([("m", p, b, x) for p in range(40) for b, x in zip("ACGT", (0.5, 0.5, 0.0, 0.0))], "motif string, pos int, base string, prob double")
    seq = motifs.consensus(m, seed=1).first()["seq"]
    assert len(seq) == 40 and set(seq) == {"A", "C"} and motifs.consensus(m, seed=2).first()["seq"] != seq
    made = spark.createDataFrame([(1, "m", 0, 2, "+", 3.0), (2, "m", 0, 2, "+", -1.0)], "id long, motif string, start long, end long, strand string, score_diff double")
    assert [r["id"] for r in motifs.by_difference(made).collect()] == [2, 1]
