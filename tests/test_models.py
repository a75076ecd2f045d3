"""K-mer scores, substitutions, moments over backgrounds and designs against plain Python."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S, tables
from helixframe.operators import expand, kmers, scoring

WEIGHTS = {"a": [((c * 7 + 3) % 11) / 3.7 - 1 for c in range(64)], "b": [((c * 5 + 1) % 13) / 3 for c in range(64)]}


def score(seq, w, k=3):
    codes = [["ACGT".find(x) for x in seq[i : i + k]] for i in range(len(seq) - k + 1)]
    return sum(w[sum(x * 4 ** (k - 1 - j) for j, x in enumerate(c))] for c in codes if min(c) >= 0) / len(codes)


def seqs(spark, n=12, seed=1, low=3, high=40, letters="ACGTACGTN"):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, seq string")


def test_kmer_scores(spark):
    rows, df = seqs(spark)
    got = {(r["id"], r["task"]): r["value"] for r in scoring.score_by(df, kmers.scorer(WEIGHTS)).collect()}
    assert got == pytest.approx({(i, t): score(s, w) for i, s in rows for t, w in WEIGHTS.items()})
    short = spark.createDataFrame([(1, "AC"), (2, ""), (3, None)], "id long, seq string")
    assert {r["value"] for r in scoring.score_by(short, kmers.scorer(WEIGHTS)).collect()} == {None}
    with pytest.raises(ValueError):
        kmers.scorer({"a": [1.0] * 5})


@pytest.mark.parametrize("drop_ref", [True, False])
def test_substitutions_match_whole_mutants(spark, drop_ref):
    """Rescoring only the windows around a place gives what scoring every whole mutant gives."""
    rows, df = seqs(spark)
    got = {(r["id"], r["task"], r["pos"], r["base"]): (r["own"], r["value"]) for r in kmers.substitution_scores(df, WEIGHTS, drop_ref=drop_ref).collect()}
    want = {(i, t, p, b): (score(s, w), score(s[:p] + b + s[p + 1 :], w)) for i, s in rows for t, w in WEIGHTS.items() for p in range(len(s)) for b in "ACGT" if not (drop_ref and s[p] == b)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    some = kmers.ism_scores(df, WEIGHTS, positions=[0, 5, 99]).collect()
    assert {r["pos"] for r in some} == {0, 5} and all(r["effect"] == pytest.approx(want.get((r["id"], r["task"], r["pos"], r["base"]), (0, 0))[1] - score(rows[r["id"]][1], WEIGHTS[r["task"]])) for r in some if (r["id"], r["task"], r["pos"], r["base"]) in want)


def middle(seq, allele):
    at = (len(seq) - len(allele)) // 2
    return seq[:at] + allele + seq[at + len(allele) :]


def test_moments_over_backgrounds(spark):
    """Mean and deviation over shuffles, against the shuffled rows scored one by one."""
    rows, df = seqs(spark, 6, 2, 30, 30, "ACGT")
    windows = df.select("id", F.lit("A").alias("ref"), F.lit("CCG").alias("alt"), "seq")
    shuffled = expand.dinuc_shuffle(windows, 8, 3)
    held = {}
    for r in shuffled.collect():
        held.setdefault(r["id"], []).append(score(middle(r["seq"], "CCG"), WEIGHTS["a"]) - score(middle(r["seq"], "A"), WEIGHTS["a"]))
    got = {r["id"]: r for r in scoring.variant_moments(shuffled, kmers.scorer(WEIGHTS)).filter("task = 'a'").collect()}
    for i, own in held.items():
        assert (got[i]["n"], got[i]["background_mean"], got[i]["background_sd"]) == (8, pytest.approx(statistics.fmean(own)), pytest.approx(statistics.pstdev(own)))
    effects = df.select("id", F.lit("a").alias("task"), F.lit(1.0).alias("effect"))
    z = {r["id"]: r["z"] for r in scoring.against_moments(effects, scoring.variant_moments(shuffled, kmers.scorer(WEIGHTS))).collect()}
    assert z[0] == pytest.approx((1.0 - statistics.fmean(held[0])) / statistics.pstdev(held[0]))
    made = scoring.pattern_moments(df, ["CAT", "G"], kmers.scorer(WEIGHTS)).filter("task = 'b'").collect()
    assert {(r["id"], r["pattern"]): r["background_mean"] for r in made} == pytest.approx({(i, p): score(middle(s, p), WEIGHTS["b"]) - score(s, WEIGHTS["b"]) for i, s in rows for p in ("CAT", "G")})


def test_tiles_are_shuffled_and_scored(spark):
    rows, df = seqs(spark, 5, 3, 60, 60, "ACGT")
    shuffled = expand.tile_shuffles(df, 20, 60, 20, 0, 4, 1).persist()
    of, held = dict(rows), {}
    for r in shuffled.collect():
        s, t = of[r["id"]], r["seq"]
        at = r["tile_start"]
        assert s[:at] == t[:at] and s[at + 20 :] == t[at + 20 :] and s[at] == t[at] and s[at + 19] == t[at + 19]
        pairs = lambda x: sorted(x[i : i + 2] for i in range(len(x) - 1))
        assert pairs(s[at : at + 20]) == pairs(t[at : at + 20])
        held.setdefault((r["id"], at), []).append(score(t, WEIGHTS["a"]) - score(s, WEIGHTS["a"]))
    got = {(r["id"], r["tile_start"]): r["background_mean"] for r in scoring.tile_moments(shuffled, df, kmers.scorer(WEIGHTS)).filter("task = 'a'").collect()}
    assert got == pytest.approx({k: statistics.fmean(v) for k, v in held.items()})
    assert sum(len(set(v)) > 1 for v in held.values()) > 10  # shuffles differ


def plain_evolution(rows, score_of, rounds, for_each, stop):
    """Best rows of each round: (iter, id, pos, allele)."""
    now, out = dict(rows), []
    if not for_each:
        now = dict([min(now.items(), key=lambda x: (-score_of(x[1]), x[0]))])
    best = max(map(score_of, now.values()))
    last = {i: score_of(s) for i, s in now.items()}
    for turn in range(1, rounds + 1):
        made = [(-score_of(s[:p] + b + s[p + 1 :]), i, p, b, s[:p] + b + s[p + 1 :]) for i, s in now.items() for p in range(len(s)) for b in "ACGT" if s[p] != b]
        top = {i: min(m for m in made if m[1] == i) for i in now} if for_each else {min(made)[1]: min(made)}
        out += [(turn, i, m[2], m[3]) for i, m in top.items()]
        if stop == "each":
            now = {i: m[4] for i, m in top.items() if -m[0] > last[i]}
            last = {i: -m[0] for i, m in top.items()}
            if not now:
                break
        else:
            now = {i: m[4] for i, m in top.items()}
            if max(-m[0] for m in top.values()) <= best:
                break
            best = max(-m[0] for m in top.values())
    return sorted(out)


@pytest.mark.parametrize("for_each, stop", [(True, "all"), (True, "each"), (False, "all")])
def test_evolution(spark, for_each, stop):
    rows, df = seqs(spark, 4, 5, 4, 9, "ACGT")
    w = {"A": 0.0, "C": 1.0, "G": 2.0, "T": 0.5}
    score_of = lambda s: sum(w[x] for x in s) / len(s)
    made = scoring.evolve(df, w, max_iter=12, for_each=for_each, stop=stop)
    got = sorted((r["iter"], r["id"], r["pos"], r["allele"]) for r in made.filter("best_in_iter AND iter > 0").collect())
    assert got == plain_evolution(rows, score_of, 12, for_each, stop)
    if stop == "each":
        assert len({max(x[0] for x in got if x[1] == i) for i, _ in rows}) > 1  # starts leave at different rounds
    assert scoring.evolve(df.limit(0), w, for_each=for_each, stop=stop).count() == 0


def test_table_functions(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, "ACGTAC"), (2, None), (3, "A")], "id long, seq string")
    got = spark.sql("SELECT id, t.* FROM {df}, LATERAL sequence_tiles(seq, 4, 2) t ORDER BY tile_start", df=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "ACGT"), (1, 2, "GTAC")]
    assert spark.sql("SELECT id, t.* FROM {df}, LATERAL sequence_mutants(seq) t", df=df).filter("id = 3").collect() == [(3, 0, b, "A") for b in "CGT"]


def test_motif_alignments_against_all_draws(spark):
    """The chance of an alignment, against every way to draw the target columns of its stretch."""
    from itertools import product

    from helixframe.operators import motifs

    columns = {"q": [(0.7, 0.1, 0.1, 0.1), (0.1, 0.2, 0.6, 0.1)], "x": [(0.6, 0.2, 0.1, 0.1), (0.25, 0.25, 0.25, 0.25), (0.1, 0.1, 0.7, 0.1)], "y": [(0.1, 0.1, 0.1, 0.7)]}
    table = lambda *names: spark.createDataFrame([(m, i, b, p) for m in names for i, c in enumerate(columns[m]) for b, p in zip("ACGT", c)], "motif string, pos int, base string, prob double")
    every = [c for m in "xy" for c in columns[m]] + [c[::-1] for m in "xy" for c in columns[m]]
    step = lambda a, b: int(sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 / 0.01 + 0.5)
    got = {(r["target"]): r for r in motifs.motif_similarity(table("q"), table("x", "y")).collect()}
    for target in "xy":
        chances = []
        for strand in "+-":
            t = columns[target] if strand == "+" else [c[::-1] for c in columns[target][::-1]]
            for offset in range(-1, len(t)):
                met = [(i, i + offset) for i in range(2) if 0 <= i + offset < len(t)]
                seen = sum(step(columns["q"][i], t[j]) for i, j in met)
                draws = [sum(step(columns["q"][i], c) for (i, _), c in zip(met, own)) for own in product(every, repeat=len(met))]
                chances.append((round(sum(d <= seen for d in draws) / len(draws), 12), -len(met), strand, offset))
        p, overlap, strand, offset = min(chances)
        assert (got[target]["strand"], got[target]["offset"], got[target]["overlap"]) == (strand, offset, -overlap)
        assert got[target]["p_value"] == pytest.approx(1 - (1 - min(p, 1 - 1e-15)) ** len(chances))
    assert got["x"]["query_consensus"] == "AG" and got["y"]["target_consensus"] == "T"


@pytest.mark.parametrize("of_counts", [{"A": 0.5, "C": 1.0, "G": 3.0, "T": 3.0}, None])
def test_evolve_by_counts(spark, of_counts):
    """The first mutant of each kind gives the rows that all mutants together mark as best, ties and other letters included."""
    rows, df = seqs(spark, 20, 9, 1, 25)
    gc = lambda d: d.withColumn("total_score", -F.abs(F.length("seq") - 2 * F.length(F.translate("seq", "GC", ""))).cast("double"))
    want = scoring.evolve(df, of_counts or gc, max_iter=3).filter("best_in_iter").collect()
    got = scoring.evolve(df, of_counts or gc, max_iter=3, by_counts=True).collect()
    assert len(want) >= 40 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(ValueError):
        scoring.evolve(df, gc, "pattern", ["GG"], by_counts=True)


def test_tiles_carry_their_sequence(spark):
    """Effects of tiles are the same whether the whole sequence is joined or stands in the row."""
    _, df = seqs(spark, 5, 4, 40, 60, "ACGT")
    made = expand.tile_shuffles(df.withColumn("own", F.col("seq")), 12, F.length("seq"), 6, 4, 2, 1)
    got, want = (scoring.tile_moments(made, x, kmers.scorer(WEIGHTS)).collect() for x in (None, df))
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))
    apart = seqs(spark, 40, 5, 0, 9)[1].select(*[t.alias(n) for n, t in kmers.kmer_totals(F.col("seq"), WEIGHTS).items()])
    assert all(r["a"] is not None for r in apart.collect())


def test_specificity_adds_the_last_place_first(spark, tmp_path):
    """A text whose off-task sum is 12 by the numbers and above it in the SQL's order of addition."""
    from __spark_entry__ import oracle_sql, queries
    import duckdb

    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 90))), "en", "s", 1) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(con.execute(f"SELECT id, specificity FROM ({oracle_sql()['specificity']})").fetchall())
    got = {r["id"]: r["specificity"] for r in queries()["specificity"](spark, str(tmp_path)).collect()}
    assert got == want


def test_best_matches_of_any_pred(spark, tmp_path):
    """Five matches a task, also where no pred is small."""
    from __spark_entry__ import queries

    rows = [(i, f"{i % 2 + 1}-X", 300000.0 + i, "F") for i in range(20)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries()["best_matches"](spark, str(tmp_path)).collect()
    assert sorted((r["query"], r["target"], r["place"]) for r in got) == [(f"{t + 1}-X", 2 * k + t, k + 1) for t in range(2) for k in range(5)]


def test_counts_by_phase(spark):
    """Counts within the row, of places by their remainder; nulls and empty strings."""
    df = spark.createDataFrame([(1, "ACGTACGA"), (2, ""), (3, None), (4, "NNCA")], "id long, seq string")
    got = {r["id"]: r["x"] for r in df.select("id", S.phase_counts(F.col("seq"), 3).alias("x")).collect()}
    assert got == {1: [[("ACGTACGA"[r::3]).count(b) for b in "ACGT"] for r in range(3)], 2: [[0] * 4] * 3, 3: None, 4: [[1, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 0]]}


def test_shuffles_side_by_side():
    """Whatever a batch holds beside it, a text gives the same walk; all walks of a text come up, each as often as others."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for letters in ("ACGT", "A", "ACGTN", "xäé") for _ in range(40)] + ["".join(map(chr, range(300, 900))) * 2, "ACGGT" * 500]
    draws = np.array([rng.getrandbits(64) for _ in texts], "uint64")
    made = expand._shuffled(texts, draws)
    pairs = lambda s: sorted(zip(s, s[1:]))
    assert all(pairs(a) == pairs(b) and a[0] == b[0] and a[-1] == b[-1] for a, b in zip(texts, made)) and sum(a != b for a, b in zip(texts, made)) > 100
    assert made == [expand._shuffled([t], draws[i : i + 1])[0] for i, t in enumerate(texts)]
    seen = Counter(expand._shuffled(["ACAGACCTAGA"] * 24_000, np.arange(24_000).astype("uint64")))
    assert len(seen) == 24 and all(850 < n < 1150 for n in seen.values())


def test_shuffles_of_nulls_and_long_batches(spark):
    """Nulls and empty strings stay, and batches of more than a slice give what rows alone give."""
    df = spark.createDataFrame([(1, None), (2, ""), (3, "AC"), *[(i, "ACGTTGCA" * 500) for i in range(4, 100)]], "id long, seq string").coalesce(1)
    got = {(r["id"], r["shuffle"]): r["seq"] for r in expand.dinuc_shuffle(df, 2, 1).collect()}
    assert [got[i, 1] for i in (1, 2, 3)] == [None, "", "AC"] and len(set(got.values())) == 2 * 96 + 3
    alone = expand.dinuc_shuffle(df.filter("id = 90"), 2, 1).collect()
    assert {(r["id"], r["shuffle"]): r["seq"] for r in alone} == {k: got[k] for k in [(90, 0), (90, 1)]}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def letters_table(spark, folder, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_importance_within_the_row(spark):
    """Means over three other bases (four for a letter that is none) without a shuffle; sequences that share an id are put together."""
    from math import log2

    w = {"A": 0.5, "C": 1.0, "G": 2.0, "T": 3.0}
    value = lambda s: sum(w.get(x, 0) for x in s) / len(s)
    rows = [(1, "ACGTN"), (2, "GG"), (2, "TCA"), (3, ""), (4, "N"), (None, "AC"), (None, "GT")]
    held = {}
    for i, s in rows:
        for p, x in enumerate(s):
            alts = [value(s[:p] + b + s[p + 1 :]) / value(s) for b in "ACGT" if b != x] if value(s) else []
            held.setdefault((i, p), []).extend(-log2(a) for a in alts)
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {(r["id"], r["pos"]): r["importance"] for r in scoring.ism_importance(df, {"t": w}).collect()}
    assert got == {k: pytest.approx(statistics.fmean(v)) if v else None for k, v in held.items()}
    assert "Exchange" not in plan_of(scoring.ism_importance(df.filter("id IN (1, 4)"), {"t": w}))


def test_effects_are_made_once_a_letter(spark, tmp_path):
    """The query's rounding stands below the rows, and any comparison gives what whole mutants give."""
    from __spark_entry__ import queries

    w, df = {"A": 0.5, "C": 1.0, "G": 2.0, "T": 3.0}, spark.createDataFrame([(1, "ACGTNA"), (2, "")], "id long, seq string")
    value = lambda s: sum(w.get(x, 0) for x in s) / len(s)
    got = {(r["pos"], r["base"]): r["effect"] for r in scoring.ism_scores(df, {"t": w}, "divide", positions=[0, 4]).collect()}
    assert got == {(p, b): pytest.approx(value("ACGTNA"[:p] + b + "ACGTNA"[p + 1 :]) / value("ACGTNA")) for p in (0, 4) for b in "ACGT"}
    d = letters_table(spark, tmp_path, [(1, "acgt" * 60), (2, "xx"), (3, "a")])
    made = queries()["ism_scores"](spark, d)
    assert made.count() == 241 * 4
    above = plan_of(made).split("explode")[0]
    assert "round" not in above


def test_sites_are_scanned_once(spark, tmp_path):
    """Attributions are of the letters of the sites; the scan is written and takes no further part in the plan."""
    from __spark_entry__ import oracle_sql, queries
    import duckdb

    rng = random.Random(5)
    d = letters_table(spark, tmp_path, [(i, "".join(rng.choice("acgtx") for _ in range(300))) for i in range(300)])
    made = queries()["site_attributions"](spark, d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    want = con.execute(oracle_sql()["site_attributions"]).fetchall()
    assert len(want) > 20 and sorted(map(tuple, made.collect())) == sorted(want)
    assert "MapInPandas" not in plan_of(made) and "regexp_replace" not in plan_of(made)


def test_letters_are_taken_once(spark, tmp_path):
    """Letters that upper case alone makes are in; a text is cut once a pass, and the queries of many passes read it written."""
    from __spark_entry__ import queries
    from helixframe.plans import tables as T

    rng = random.Random(6)
    texts = [(0, None), (1, ""), (2, "xyz"), (3, "aß\ufb05c"), *[(i, "".join(rng.choice("acgtx") for _ in range(700))) for i in range(10, 60)]]
    rows = [(i, t, "en", "s", 1) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: "".join(x for x in t.upper() if x in "ACGT") for i, t in texts if t}
    assert {r["doc_id"]: r["s"] for r in T.letters(spark, str(tmp_path)).collect()} == {i: s for i, s in held.items() if s}
    made = T.sequences(spark, str(tmp_path))
    whole = {}
    for r in made.orderBy("id").collect():
        whole.setdefault(r["id"] // 1_000_000, []).append(r["seq"])
    assert {i: "".join(s) for i, s in whole.items()} == {i: s for i, s in held.items() if s}
    assert plan_of(made.filter(F.length("seq") > 41)).count("regexp_replace") == 1
    assert "regexp_replace" not in plan_of(queries()["gc_negatives_from_genome"](spark, str(tmp_path)))


def test_windows_of_a_matrix_read_written_letters(spark):
    """Four passes over the sequences, none of which takes letters out of texts."""
    from __spark_entry__ import queries

    made = queries()["matrix_windows"](spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and "regexp_replace" not in plan_of(made)
