"""Further registered queries: readers over files written from the tables, windows, motifs, losses and designs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import coverage, expand, genome, intervals as I, matrix as M, metrics, motifs, scoring, variants as V, windows
from helixframe.plans import tables as T
from helixframe.plans.queries import ORACLES, _DENSE, _LOCAL, _ODDS, TASKS, _dense, _local_variants, _long, _score_sql, query, six
from helixframe.scratch import cut, shared_folder
from helixframe.sources import files


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame) -> str:
    """Writes one string column as text files; gives the folder."""
    folder = _folder(spark)
    lines.write.text(folder)
    return folder


def _tabbed(*columns) -> F.Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).alias("value")


# readers: the tables are written in each format and read back


@query("read_bed", "SELECT chrom, cast(istart AS bigint) AS istart, cast(iend AS bigint) AS iend, cast(id AS varchar) AS name FROM intervals", "intervals")
def read_bed(spark, d):
    path = _written(spark, T.intervals(spark, d).select(_tabbed("chrom", "start", "end", "id")))
    return files.read_bed(spark, path).select("chrom", F.col("start").alias("istart"), F.col("end").alias("iend"), F.col("_c3").alias("name"))


@query("read_narrowpeak", "SELECT chrom, cast(istart AS bigint) AS istart, cast(id AS varchar) AS name, strand, cast((iend-istart)//2 AS bigint) AS summit FROM intervals", "intervals")
def read_narrowpeak(spark, d):
    size = F.col("end") - F.col("start")
    lines = T.intervals(spark, d).select(_tabbed("chrom", "start", "end", "id", F.lit(10), "strand", F.lit(1.5), F.lit(2), F.lit(3), F.floor(size / 2)))
    head = spark.range(1).select(F.lit("track type=narrowPeak").alias("value"))
    made = files.read_narrowpeak(spark, _written(spark, lines.unionByName(head)))
    return made.select("chrom", F.col("start").alias("istart"), "name", "strand", "summit")


@query("read_fasta", "SELECT 'seq' || id AS name, seq FROM sequences", "sequences")
def read_fasta(spark, d):
    record = F.concat(F.lit(">seq"), "id", F.lit(" a > sign\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    return files.read_fasta(spark, _written(spark, T.sequences(spark, d).select(record.alias("value"))))


@query("read_fasta_chunks", "SELECT 'seq' || id AS chrom, cast(k AS integer) AS chunk_id, substring(seq, k*64+1, 64) AS bases FROM (SELECT *, unnest(range(0, (length(seq)+63)//64)) AS k FROM sequences)", "sequences")
def read_fasta_chunks(spark, d):
    """Written in lines of 60 letters, read straight into chunks."""
    lines = T.sequences(spark, d).select(F.concat(F.lit(">seq"), "id", F.lit(" a record\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    return files.read_fasta_chunks(spark, _written(spark, lines), 64)


@query("genome_sizes", "SELECT 'seq' || id AS chrom, cast(length(seq) AS bigint) AS size FROM sequences", "sequences")
def genome_sizes(spark, d):
    sizes = genome.genome_sizes(T.sequences(spark, d).select(F.concat(F.lit("seq"), "id").alias("name"), "seq"))
    return files.read_sizes(spark, _written(spark, sizes.select(_tabbed("chrom", "size"))))


@query("read_gtf", "SELECT chrom, cast(istart AS bigint) AS istart, cast(iend AS bigint) AS iend, strand, 'g' || id AS gene_name FROM intervals WHERE id % 2 = 0", "intervals")
def read_gtf(spark, d):
    feature = F.when(F.col("id") % 2 == 0, "gene").otherwise("exon")
    about = F.concat(F.lit('gene_id "'), "id", F.lit('"; gene_name "g'), "id", F.lit('";'))
    lines = T.intervals(spark, d).select(_tabbed("chrom", F.lit("made"), feature, F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), about))
    made = files.read_gtf(spark, _written(spark, lines), ["gene"])
    return made.select("chrom", F.col("start").alias("istart"), F.col("end").alias("iend"), "strand", "gene_name")


@query("read_bedgraph", "SELECT chrom, cast(pos AS bigint) AS istart, cast(count(*) AS double) AS value FROM (SELECT chrom, istart AS pos FROM intervals UNION ALL SELECT chrom, iend-1 FROM intervals) GROUP BY chrom, pos", "intervals")
def read_bedgraph(spark, d):
    runs = coverage.insertion_counts(T.intervals(spark, d)).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("depth").cast("double").alias("value"))
    folder = _folder(spark)
    files.write_bedgraph(runs, folder, 4)
    return files.read_bedgraph(spark, folder).select("chrom", F.col("start").alias("istart"), "value")


@query("load_blacklist", "SELECT chrom, cast(istart AS bigint) AS istart, cast(iend AS bigint) AS iend FROM blacklist", "blacklist")
def load_blacklist(spark, d):
    folder = _folder(spark)
    T.blacklist(spark, d).select(_tabbed("chrom", "start", "end")).write.text(f"{folder}/hgmade-blacklist.v2.bed")
    made = files.load_blacklist(spark, "hgmade", folder)
    return made.select("chrom", F.col("start").alias("istart"), F.col("end").alias("iend"))


#: Base counts of each document's letters by place modulo 6, as a motif: probabilities by position and base.
_COUNTED = """SELECT id, p AS pos, b AS base, (n+1)/(sum(n+1) OVER (PARTITION BY id, p))::double AS prob FROM (
 SELECT s.id, p, b, count(i) AS n FROM sequences s, generate_series(0,5) g(p), (VALUES ('A'),('C'),('G'),('T')) v(b)
 LEFT JOIN generate_series(1,400) h(i) ON i <= length(s.seq) AND i % 6 = p AND substring(s.seq,i,1) = b GROUP BY s.id, p, b)"""


def _document_motifs(spark, d) -> DataFrame:
    """(motif, pos, base, prob): each sequence's base shares by place modulo 6, one added to each count."""
    counts = T.sequences(spark, d).select("id", S.phase_counts(F.col("seq"), 6).alias("counts")).select("id", F.posexplode("counts").alias("phase", "x"))
    # places count from 1
    grid = counts.select("id", ((F.col("phase") + 1) % 6).alias("pos"), *[F.get("x", F.lit(i)).alias(b) for i, b in enumerate("ACGT")])
    total = sum((F.col(b) for b in "CGT"), F.col("A")) + 4
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), ((F.col(b) + 1) / total).alias("prob")) for b in "ACGT"])).alias("x")
    return grid.select(F.concat(F.lit("m"), "id").alias("motif"), "pos", cells).select("motif", "pos", "x.base", "x.prob")


@query("read_meme", f"SELECT 'm' || id AS motif, cast(pos AS bigint) AS pos, base, round(prob, 6) AS prob FROM ({_COUNTED})", "sequences")
def read_meme(spark, d):
    rows = _document_motifs(spark, d).groupBy("motif", "pos").agg(*[F.max(F.when(F.col("base") == b, F.col("prob"))).alias(b) for b in "ACGT"])
    line = F.concat_ws(" ", *[F.col(b).cast("string") for b in "ACGT"])
    whole = rows.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    text = F.concat(F.lit("MEME version 4\n\nMOTIF "), "motif", F.lit("\nletter-probability matrix: alength= 4 w= 6\n"), "lines", F.lit("\n"))
    made = files.read_meme(spark, _written(spark, whole.select(text.alias("value"))))
    return made.select("motif", F.col("pos").cast("long").alias("pos"), "base", six("prob").alias("prob"))


@query("read_matches", "SELECT 'q' || task AS query, cast(id AS varchar) AS target, round(pred, 6) AS q_value FROM preds WHERE pred <= 0.05", "preds")
def read_matches(spark, d):
    p = T.preds(spark, d).select("id", F.substring("task", 1, 1).alias("t"), "task", "pred")
    folder = _folder(spark)
    head = "Query_ID\tTarget_ID\tp-value\tE-value\tq-value"
    for task in [r["task"] for r in p.select("task").distinct().collect()]:  # five order priorities
        lines = p.filter(F.col("task") == task).select(_tabbed(F.lit("1"), "id", "pred", "pred", "pred"))
        # the header must come first in each file
        lines.withColumn("k", F.lit(1)).unionByName(spark.range(1).select(F.lit(head).alias("value"), F.lit(0).alias("k"))).coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{folder}/{task}.parts")
        _rename(spark, f"{folder}/{task}.parts", f"{folder}/q{task}.tomtom.tsv")
    return files.read_matches(spark, folder).select(F.regexp_replace("Query_ID", "%20", " ").alias("query"), F.col("Target_ID").cast("string").alias("target"), six("q_value").alias("q_value"))


def _rename(spark: SparkSession, folder: str, path: str) -> None:
    """Moves a folder's one part file to a path of its own."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(where, True)


# intervals, windows and labels


@query("cropped_intervals", "SELECT id, cast(istart+16 AS bigint) AS istart, cast(iend-16 AS bigint) AS iend FROM intervals WHERE strand = '-'", "intervals")
def cropped_intervals(spark, d):
    made = I.crop_intervals(I.filter_intervals(T.intervals(spark, d), F.col("strand") == "-"), 8, 2)
    return made.select("id", F.col("start").alias("istart"), F.col("end").alias("iend"))


@query("sampled_split", "SELECT split, cast(CASE WHEN split = 'train' THEN least(n, 700) ELSE n END AS bigint) AS n, true AS distinct_ids FROM (SELECT CASE WHEN chrom='chr10' THEN 'val' WHEN chrom='chr11' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM intervals GROUP BY 1)", "intervals")
def sampled_split(spark, d):
    made = I.split(T.intervals(spark, d), sample={"train": 700}, seed=2)
    return made.groupBy("split").agg(F.count("*").alias("n"), (F.count_distinct("id") == F.count("*")).alias("distinct_ids"))


@query("sample_is_distinct", "SELECT cast(least(count(*), 500) AS bigint) AS n, true AS of_the_table FROM intervals", "intervals")
def sample_is_distinct(spark, d):
    rows = T.intervals(spark, d)
    made = I.sample_n(rows, 500, seed=3)
    return made.join(rows.select("id", F.lit(True).alias("there")), "id", "left").agg(F.count_distinct("id").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("of_the_table"))


@query("labeled_windows", """SELECT id, task, value, CASE WHEN length(seq) < 154 THEN repeat('N', ((154-length(seq))//2)::int) || seq || repeat('N', (154-length(seq)-(154-length(seq))//2)::int) ELSE substring(seq, (length(seq)-154)//2+1, 154) END AS seq
 FROM (SELECT id, seq, 'gc' AS task, cast(length(seq)-length(translate(seq,'GC','')) AS bigint) AS value FROM sequences UNION ALL SELECT id, seq, 'a', cast(length(seq)-length(replace(seq,'A','')) AS bigint) FROM sequences)""", "sequences")  # fmt: skip
def labeled_windows(spark, d):
    n = F.length("seq")
    rows = T.sequences(spark, d).select("id", "seq", (n - F.length(F.translate("seq", "GC", ""))).cast("long").alias("gc"), (n - F.length(F.translate("seq", "A", ""))).cast("long").alias("a"))
    seqs, labels = windows.labeled_sequences(rows, 150, ["gc", "a"], 1, 1)
    return seqs.join(labels, "id").select("id", "task", "value", "seq")


@query("matrix_windows", """SELECT id, task, value, seq FROM (SELECT id, 'doc' || id AS chrom, substring(seq, cast(ceil(length(seq)/2.0-10) AS bigint)+1, 20) AS seq FROM sequences WHERE length(seq) > 41)
 JOIN (SELECT obs AS task, var, value FROM matrix) ON id // 1000000 = var""", "sequences", "matrix")  # fmt: skip
def matrix_windows(spark, d):
    # read in four passes
    seqs = cut(_long(T.sequences(spark, d)).select("id", "seq"))
    chunks = genome.genome_chunks(seqs.select(F.concat(F.lit("doc"), "id").alias("name"), "seq"), T.CHUNK)
    var = seqs.select(F.col("id").alias("var"), F.concat(F.lit("doc"), "id").alias("chrom"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"))
    cells = T.matrix(spark, d).join(var.select(F.floor(F.col("var") / 1_000_000).alias("of"), F.col("var").alias("piece")), F.col("var") == F.col("of")).select("obs", F.col("piece").alias("var"), "value")
    wins, labels = windows.matrix_windows(var, cells, chunks, 20, T.CHUNK)
    return labels.join(wins, "id").select("id", "task", "value", "seq")


@query("negatives_are_drawn", "SELECT is_negative, count(*) AS n FROM (SELECT total >= 5 AS k FROM (SELECT sum(value)/(SELECT count(DISTINCT obs) FROM matrix) AS total FROM matrix GROUP BY var)), (VALUES (false),(true)) v(is_negative) WHERE false GROUP BY is_negative UNION ALL SELECT false, count(*) FILTER (total >= 5) FROM (SELECT sum(value)/(SELECT count(DISTINCT obs) FROM matrix) AS total FROM matrix GROUP BY var) UNION ALL SELECT true, least(cast(floor(0.2*count(*) FILTER (total >= 5)) AS bigint), count(*) FILTER (total < 5)) FROM (SELECT sum(value)/(SELECT count(DISTINCT obs) FROM matrix) AS total FROM matrix GROUP BY var)", "matrix")
def negatives_are_drawn(spark, d):
    m = T.matrix(spark, d)
    made = M.filter_coverage(m, m.select("obs").distinct().count(), "cutoff", 5, negative_frac=0.2, seed=1)
    counts = made.filter(F.col("is_negative") == (F.col("total") < 5)).groupBy("is_negative").agg(F.count("*").alias("n"))
    both = spark.createDataFrame([(False,), (True,)], "is_negative boolean")
    return both.join(counts, "is_negative", "left").fillna(0, ["n"])


# sequences, designs and models


@query("mutants_differ_once", "SELECT id, 1::bigint AS n_different, true AS as_said FROM sequences", "sequences")
def mutants_differ_once(spark, d):
    seqs = T.sequences(spark, d).select("id", "seq")
    met = expand.random_mutants(seqs, 4).withColumnRenamed("seq", "mutant").join(seqs, "id")
    off = S.differences(F.col("seq"), F.col("mutant"))
    return met.select("id", F.size(off).cast("long").alias("n_different"), ((F.element_at(off, 1) == F.col("pos")) & (F.substring(F.col("mutant"), F.col("pos") + 1, F.lit(1)) == F.col("base"))).alias("as_said"))


@query("tile_shuffles_keep_composition", "SELECT id, s AS tile_start, 0.0::double AS effect FROM sequences, generate_series(0, 400, 25) g(s) WHERE s <= length(seq)-50 AND (s+50 <= (length(seq)-6)//2 OR s >= (length(seq)-6)//2+6)", "sequences")
def tile_shuffles_keep_composition(spark, d):
    from helixframe.plans.queries import QUERIES

    made = QUERIES["tile_shuffle_effects"](spark, d)
    return made.select("id", F.col("tile_start").cast("long").alias("tile_start"), (F.col("effect") + 0.0).alias("effect"))


@query("user_model_scores", f"SELECT id, 't1' AS task, round({_score_sql('seq', 't1')},6) AS value FROM sequences UNION ALL SELECT id, 't2', round({_score_sql('seq', 't2')},6) FROM sequences", "sequences")
def user_model_scores(spark, d):
    tasks = TASKS

    def load():
        import pandas as pd

        def model(seqs: list[str]) -> pd.DataFrame:
            rows = [(i, t, sum(s.count(b) * w for b, w in own.items()) / len(s)) for i, s in enumerate(seqs) for t, own in tasks.items()]
            return pd.DataFrame(rows, columns=["row", "task", "value"])

        return model

    return scoring.score_sequences(T.sequences(spark, d).select("id", "seq"), load).withColumn("value", six("value"))


_BALANCED = f"{_score_sql('seq', 't1')} - 8.0::double*abs((length(seq)-length(translate(seq,'GC','')))/length(seq)::double - 0.5::double)"
_ROUND = """m{i} AS (SELECT r.id, p-1 AS pos, b AS allele, substring(seq,1,p-1) || b || substring(seq,p+1) AS seq FROM r{j} r, generate_series(1,400) g(p), (VALUES ('A'),('C'),('G'),('T')) v(b) WHERE p <= length(seq) AND b <> substring(seq,p,1)),
 s{i} AS (SELECT *, {score} AS total_score FROM m{i}),
 r{i} AS (SELECT {i} AS iter, id, pos, allele, seq, total_score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY total_score DESC, pos, allele) AS k FROM s{i}) WHERE k = 1)"""
_EVOLVED = ", r0 AS (SELECT 0 AS iter, id, -1 AS pos, '' AS allele, seq, {score} AS total_score FROM sequences WHERE length(seq) > 41), ".format(score=_BALANCED) + ", ".join(_ROUND.format(i=i, j=i - 1, score=_BALANCED) for i in (1, 2))


@query("evolved_best", _EVOLVED + " SELECT cast(iter AS bigint) AS iter, id, cast(pos AS bigint) AS pos, allele, seq, round(total_score, 6) AS total_score FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 WHERE (SELECT max(total_score) FROM r1) > (SELECT max(total_score) FROM r0))", "sequences")
def evolved_best(spark, d):
    balance = F.abs(S.gc_fraction(F.col("seq")) - 0.5)
    score = lambda df: df.withColumn("total_score", scoring.linear_score(F.col("seq"), TASKS["t1"]) - 8.0 * balance)
    made = scoring.evolve(_long(T.sequences(spark, d)).select("id", "seq"), score, max_iter=2, by_counts=True)
    return made.select(F.col("iter").cast("long").alias("iter"), "id", F.col("pos").cast("long").alias("pos"), "allele", "seq", six("total_score").alias("total_score"))


@query("variant_effects_both_strands", f"""SELECT id, task, round(avg(v) FILTER (t='alt') / avg(v) FILTER (t='ref'), 6) AS effect FROM (
 SELECT id, t, task, CASE task WHEN 't1' THEN {_score_sql('s', 't1')} ELSE {_score_sql('s', 't2')} END AS v FROM (
 SELECT id, t, CASE WHEN rc THEN reverse(translate(s,'ACGTN','TGCAN')) ELSE s END AS s FROM (
 SELECT id, t, rc, substring(w, h+1, 18) AS s FROM (SELECT id, t, substring(seq,pos-9,9) || CASE t WHEN 'ref' THEN ref ELSE alt END || substring(seq,pos+1,10) AS w FROM ({_LOCAL}), (VALUES ('ref'),('alt')) v(t)),
 generate_series(0,2) g(h), (VALUES (false),(true)) x(rc))), (VALUES ('t1'),('t2')) y(task)) GROUP BY id, task""", "sequences")  # fmt: skip
def variant_effects_both_strands(spark, d):
    seqs = _long(T.sequences(spark, d))
    chunks = genome.genome_chunks(seqs.select(F.concat(F.lit("doc"), "id").alias("name"), "seq"), T.CHUNK)
    scored = scoring.score_linear(V.augmented_alleles(_local_variants(seqs), chunks, 18, T.CHUNK, True, 1), TASKS)
    mean = scored.withColumn("pos", F.lit(0)).select("id", "allele_type", "rc", "task", "pos", "value")
    averaged = scoring.average_augmented(mean, ["id", "allele_type"], 1)
    return scoring.allele_effects(averaged).withColumn("effect", six("effect"))


@query("spacing_effects", f"""SELECT distance, round(avg(e), 6) AS mean, count(*) AS n FROM (SELECT t.tile_start - (length(f)-4)//2 AS distance, {_score_sql("(substring(f,1,t.tile_start) || 'TTT' || substring(f,t.tile_start+4))", 't1')} - {_score_sql('f', 't1')} AS e FROM (
 SELECT id, substring(seq,1,(length(seq)-4)//2) || 'CCCC' || substring(seq,(length(seq)-4)//2+5) AS f FROM sequences WHERE length(seq) >= 20), (SELECT s AS tile_start FROM generate_series(0,400,3) g(s)) t
 WHERE t.tile_start <= length(f)-3 AND (t.tile_start+3 <= (length(f)-4)//2 OR t.tile_start >= (length(f)-4)//2+4)) GROUP BY distance""", "sequences")  # fmt: skip
def spacing_effects(spark, d):
    seqs = T.sequences(spark, d).select("id", "seq").filter(F.length("seq") >= 20)
    placed = expand.pattern_spacing(seqs, "CCCC", "TTT", F.length("seq"), 3, 0, own="own")
    effect = scoring.linear_score(F.col("seq"), TASKS["t1"]) - scoring.linear_score(F.col("own"), TASKS["t1"])
    effects = placed.select(F.col("distance").cast("long").alias("pos"), effect.alias("effect"))
    return metrics.effect_by_position(effects).select(F.col("pos").alias("distance"), six("mean").alias("mean"), "n")


@query("context_effects", f"SELECT id, round(avg((wt-mut)/wt), 6) AS context, round(avg((mut-(mut+1)/2)/wt), 6) AS sufficiency FROM (SELECT id, value+1 AS wt, value/2 AS mut FROM ({_DENSE}) WHERE task = 't1') GROUP BY id", "sequences")
def context_effects(spark, d):
    p = _dense(spark, d).filter("task = 't1'").select("id", (F.col("value") + 1).alias("wt"), (F.col("value") / 2).alias("mut"))
    both = scoring.context_effect(p).withColumnRenamed("effect", "context").join(scoring.sufficiency(p.withColumn("control", (F.col("mut") + 1) / 2)).withColumnRenamed("effect", "sufficiency"), "id")
    return both.select("id", six("context").alias("context"), six("sufficiency").alias("sufficiency"))


@query("ism_importance", f"""SELECT id, p-1 AS pos, round(avg(-log2(({_score_sql("(substring(seq,1,p-1) || b || substring(seq,p+1))", 't1')}) / ({_score_sql('seq', 't1')}))), 5) AS importance FROM sequences, generate_series(1,400) g(p), (VALUES ('A'),('C'),('G'),('T')) v(b) WHERE p <= length(seq) AND b <> substring(seq,p,1) GROUP BY id, p""", "sequences")
def ism_importance(spark, d):
    made = scoring.ism_importance(T.sequences(spark, d).select("id", "seq"), {"t1": TASKS["t1"]})
    return made.select("id", F.col("pos").cast("long").alias("pos"), F.round("importance", 5).alias("importance"))


@query("activations", f"SELECT id, pos, task, round(exp(value), 6) AS e, round(1/(1+exp(-value)), 6) AS s FROM ({_DENSE})", "sequences")
def activations(spark, d):
    p = _dense(spark, d).withColumn("raw", F.col("value"))
    made = scoring.activation(scoring.activation(p, "exp").withColumn("e", F.col("value")).withColumn("value", F.col("raw")), "sigmoid")
    return made.select("id", F.col("pos").cast("long").alias("pos"), "task", six("e").alias("e"), six("value").alias("s"))


@query("decoded_bases", "SELECT id, seq FROM sequences", "sequences")
def decoded_bases(spark, d):
    return T.sequences(spark, d).select("id", S.decode(S.encode(F.col("seq"))).alias("seq"))


@query("all_alternatives", "SELECT id, ref, a AS alt FROM variants, (VALUES ('A'),('C'),('TT')) v(a)", "variants")
def all_alternatives(spark, d):
    said = T.variants(spark, d).select("id", F.concat("ref", F.lit(">A,C,TT")).alias("v"))
    return V.split_variant_string(said, "v", every=True).select("id", "ref", "alt")


# motifs

_KMERS = """k AS (SELECT motif, s0.base || s1.base || s2.base || s3.base || s4.base || s5.base AS kmer, cast(s0.r+s1.r+s2.r+s3.r+s4.r+s5.r AS bigint) AS step FROM r s0 JOIN r s1 USING (motif) JOIN r s2 USING (motif) JOIN r s3 USING (motif) JOIN r s4 USING (motif) JOIN r s5 USING (motif)
 WHERE s0.pos=0 AND s1.pos=1 AND s2.pos=2 AND s3.pos=3 AND s4.pos=4 AND s5.pos=5)"""
_TAILS = f", r AS (SELECT motif, pos, base, round_even(log2((prob+0.0001)*4)/0.1, 0) AS r FROM motifs), {_KMERS}, span AS (SELECT motif, min(step) AS low, max(step) AS high FROM k GROUP BY motif), tails AS (SELECT s.motif, g.step AS step, (SELECT count(*) FROM k WHERE k.motif = s.motif AND k.step >= g.step)/4096.0::double AS p FROM span s, generate_series(-900, 400) g(step) WHERE g.step BETWEEN s.low AND s.high)"
_SITES = f"""SELECT id, motif, strand, istart, score, coalesce((SELECT p FROM tails t WHERE t.motif = w.motif AND t.step = greatest(cast(trunc(score/0.1) AS bigint), (SELECT low FROM span WHERE span.motif = w.motif))), 0.0) AS p FROM (
 SELECT id, motif, strand, istart, sum(score) AS score FROM (SELECT s.id, o.motif, o.strand, i-1-o.pos AS istart, o.score, length(seq) AS n FROM sequences s, generate_series(1,400) g(i) JOIN ({_ODDS}) o ON o.base = substring(s.seq,i,1) WHERE i <= length(s.seq))
 WHERE istart >= 0 AND istart + 6 <= n GROUP BY id, motif, strand, istart) w"""


@query("motif_site_pvalues", f"{_TAILS} SELECT id, motif, strand, cast(istart AS bigint) AS istart, round(score, 5) AS score, round(p, 9) AS p_value FROM ({_SITES}) WHERE p < 0.001", "sequences", "motifs")
def motif_site_pvalues(spark, d):
    found = motifs.scan_motifs(T.sequences(spark, d), T.motifs(spark), 1e-3)
    return found.select("id", "motif", "strand", F.col("start").alias("istart"), F.round("score", 5).alias("score"), F.round("p_value", 9).alias("p_value"))


@query("motif_match_scores", f"""SELECT id, motif, strand, cast(istart AS bigint) AS istart, round((SELECT sum(CASE substring(s.seq,cast(i AS bigint),1) WHEN 'G' THEN 2.0 WHEN 'C' THEN 1.0 ELSE 0.0 END * m.prob) FROM generate_series(1,400) g(i) JOIN motifs m ON m.motif = h.motif
 AND m.pos = CASE WHEN h.strand = '-' THEN h.istart+6-i ELSE i-1-h.istart END AND m.base = CASE WHEN h.strand = '-' THEN translate(substring(s.seq,cast(i AS bigint),1),'ACGT','TGCA') ELSE substring(s.seq,cast(i AS bigint),1) END WHERE i > h.istart AND i <= h.istart+6)/6.0, 6)::double AS motif_attr_score
 FROM (SELECT id, motif, strand, istart FROM (SELECT s.id, o.motif, o.strand, i-1-o.pos AS istart, o.score, length(seq) AS n FROM sequences s, generate_series(1,400) g(i) JOIN ({_ODDS}) o ON o.base = substring(s.seq,i,1) WHERE i <= length(s.seq)) WHERE istart >= 0 AND istart + 6 <= n GROUP BY id, motif, strand, istart HAVING sum(score) > 7) h JOIN sequences s USING (id)""", "sequences", "motifs")  # fmt: skip
def motif_match_scores(spark, d):
    seqs = T.sequences(spark, d)
    sites = motifs.scan_motifs(seqs, T.motifs(spark), 1e-2).filter("score > 7")
    bases = seqs.select("id", F.posexplode(F.split("seq", "")).alias("pos", "base"))
    attributions = bases.select("id", F.col("pos").cast("long").alias("pos"), "base", F.when(F.col("base") == "G", 2.0).when(F.col("base") == "C", 1.0).otherwise(0.0).alias("value"))
    made = motifs.score_motif_match(sites, attributions, T.motifs(spark))
    return made.select("id", "motif", "strand", F.col("start").alias("istart"), six("motif_attr_score").alias("motif_attr_score"))


@query("motif_consensus", f"SELECT 'm' || id AS motif, string_agg(base, '' ORDER BY pos) AS seq FROM (SELECT id, pos, base, row_number() OVER (PARTITION BY id, pos ORDER BY prob DESC, base) AS k FROM ({_COUNTED})) WHERE k = 1 GROUP BY id", "sequences")
def motif_consensus(spark, d):
    return motifs.consensus(_document_motifs(spark, d))


@query("trimmed_motifs", f"""SELECT 'm' || id AS motif, cast(pos - a AS bigint) AS pos, base, round(prob - 0.25, 6) AS prob FROM (SELECT id, pos, base, prob, a, b FROM ({_COUNTED}) JOIN (SELECT id, min(pos) AS a, max(pos) AS b FROM (
 SELECT id, pos, x, max(x) OVER (PARTITION BY id) AS top FROM (SELECT id, pos, sum(abs(prob-0.25)) AS x FROM ({_COUNTED}) GROUP BY id, pos)) WHERE x >= 0.8731*top GROUP BY id) USING (id)) WHERE pos BETWEEN a AND b""", "sequences")  # fmt: skip
def trimmed_motifs(spark, d):
    """The kept places, numbered anew, with their letters' values."""
    shares = _document_motifs(spark, d).withColumn("prob", F.col("prob") - 0.25)
    return motifs.trim_motif(shares, 0.8731).select("motif", F.col("pos").cast("long").alias("pos"), "base", six("prob").alias("prob"))


@query("best_matches", "SELECT task AS query, id AS target, cast(k AS bigint) AS place FROM (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY pred, label, id) AS k FROM preds) WHERE k <= 5", "preds")
def best_matches(spark, d):
    p = T.preds(spark, d).select(F.col("task").alias("query"), F.col("id").alias("target"), F.col("pred").alias("q_value"), F.col("label").alias("p_value"))
    made = motifs.top_matches(p, 5)
    return made.select("query", "target", F.col("place").cast("long").alias("place"))


@query("named_motifs", "SELECT 'm' || id AS motif, id % 3 = 0 AS found FROM sequences WHERE id % 3 = 0 UNION ALL SELECT 'other ' || id, false FROM sequences WHERE id % 5 = 0", "sequences")
def named_motifs(spark, d):
    seqs = T.sequences(spark, d)
    names = seqs.filter("id % 3 = 0").select(F.concat(F.lit("m"), "id").alias("motif")).unionByName(seqs.filter("id % 5 = 0").select(F.concat(F.lit("other "), "id").alias("motif")))
    found, missing = motifs.name_subset(_document_motifs(spark, d).select("motif").distinct(), names)
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


# evaluation


@query("weighted_losses", """SELECT round(avg(w*label*ln(1+exp(-pred)) + (1-label)*ln(1+exp(pred))),6) AS bce, round(sum(w*label*(total-pred))/count(DISTINCT id),6) AS ce FROM (
 SELECT *, CASE WHEN task = '1-URGENT' THEN 3.0 WHEN task = '5-LOW' THEN 0.5 ELSE 1.0 END::double AS w, ln(sum(exp(pred)) OVER (PARTITION BY id)) AS total FROM preds)""", "preds")  # fmt: skip
def weighted_losses(spark, d):
    made = metrics.evaluation_losses(T.preds(spark, d), ("bce", "ce"), {"1-URGENT": 3.0, "5-LOW": 0.5})
    return made.select(six("bce").alias("bce"), six("ce").alias("ce"))


@query("multiclass_accuracy", f"SELECT round(avg(CASE WHEN (a >= b) = (la >= lb) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT id, max(value) FILTER (task='t1') AS a, max(value) FILTER (task='t2') AS b, max(value*value-value) FILTER (task='t1') AS la, max(value*value-value) FILTER (task='t2') AS lb FROM ({_DENSE}) GROUP BY id, pos)", "sequences")
def multiclass_accuracy(spark, d):
    p = _dense(spark, d).select(F.struct("id", "pos").alias("id"), "task", F.col("value").alias("pred"), (F.col("value") * F.col("value") - F.col("value")).alias("label"))
    return metrics.multiclass_accuracy(p).withColumn("accuracy", six("accuracy"))


@query("improved_rounds", "SELECT cast(i AS bigint) AS iter, best, coalesce(best > lag(best) OVER (ORDER BY i), true) AS improved FROM (SELECT cast(substring(task,1,1) AS integer) AS i, max(pred) AS best FROM preds GROUP BY 1)", "preds")
def improved_rounds(spark, d):
    rounds = T.preds(spark, d).groupBy(F.substring("task", 1, 1).cast("int").alias("iter")).agg(F.max("pred").alias("best"))
    return scoring.score_improved(rounds).select(F.col("iter").cast("long").alias("iter"), "best", "improved")


@query("user_aggregates", f"SELECT id, round(sqrt(sum(v*v)), 6) AS value FROM (SELECT id, task, max(value)-min(value) AS v FROM ({_DENSE}) GROUP BY id, task) GROUP BY id", "sequences")
def user_aggregates(spark, d):
    made = scoring.aggregate_predictions(_dense(spark, d), length=lambda v: F.max(v) - F.min(v), task=lambda v: F.sqrt(F.sum(v * v)))
    return made.select("id", six("value").alias("value"))


_T95 = "CASE n WHEN 2 THEN 12.706204736 WHEN 3 THEN 4.302652730 WHEN 4 THEN 3.182446305 WHEN 5 THEN 2.776445105 WHEN 6 THEN 2.570581836 WHEN 7 THEN 2.446911851 ELSE 1.959963985 + 2.372271/(n-1) + 2.8225/((n-1)*(n-1)) + 2.5558/((n-1)*(n-1)*(n-1)) END"


@query("effect_intervals", f"SELECT pos, n, round(m - t*s, 2) + 0.0 AS low, round(m + t*s, 2) + 0.0 AS high FROM (SELECT *, {_T95} AS t FROM (SELECT pos, avg(value) AS m, stddev_pop(value)/sqrt(count(*)) AS s, count(*)::double AS n FROM ({_DENSE}) WHERE task='t1' GROUP BY pos)) WHERE n > 1", "sequences")
def effect_intervals(spark, d):
    """t intervals at all places, those with few rows included."""
    p = _dense(spark, d).filter("task = 't1'").withColumnRenamed("value", "effect")
    made = metrics.effect_by_position(p).filter("n > 1")
    return made.select(F.col("pos").cast("long").alias("pos"), F.col("n").cast("double").alias("n"), (F.round("low", 2) + 0.0).alias("low"), (F.round("high", 2) + 0.0).alias("high"))


_LANGUAGE = """language AS (SELECT lang AS target, p AS pos, b AS base, (n+1)/(sum(n+1) OVER (PARTITION BY lang, p))::double AS prob FROM (
 SELECT lang, i % 6 AS p, b, count(*) FILTER (substring(seq, i+1, 1) = b) AS n FROM (SELECT lang, seq, unnest(range(0, length(seq))) AS i FROM sequences), (VALUES ('A'),('C'),('G'),('T')) v(b) GROUP BY lang, i % 6, b))"""
_ALIGNED = f""", {_LANGUAGE},
 sides AS (SELECT target, pos, base, prob, '+' AS strand FROM language UNION ALL SELECT target, 5-pos, translate(base,'ACGT','TGCA'), prob, '-' FROM language),
 col AS (SELECT m.motif AS query, m.pos, s.target, s.strand, s.pos AS tp, sqrt(sum((m.prob-s.prob)*(m.prob-s.prob))) AS apart FROM motifs m JOIN sides s ON s.base = m.base GROUP BY m.motif, m.pos, s.target, s.strand, s.pos),
 step AS (SELECT *, cast(round(apart/0.01) AS bigint) AS step FROM col),
 seen AS (SELECT query, pos, step, count(*)/(sum(count(*)) OVER (PARTITION BY query, pos))::double AS p FROM step GROUP BY query, pos, step),
 own AS (SELECT query, target, tp-pos AS off, strand, min(pos) AS a, max(pos)+1 AS b, cast(sum(step) AS bigint) AS steps, count(*) AS overlap, avg(apart) AS distance FROM step GROUP BY query, target, tp-pos, strand),
 conv(query, a, b, s, p) AS (SELECT query, pos, pos+1, step, p FROM seen UNION ALL SELECT c.query, c.a, c.b+1, c.s+n.step, sum(c.p*n.p) FROM conv c JOIN seen n ON n.query = c.query AND n.pos = c.b GROUP BY c.query, c.a, c.b, c.s+n.step),
 one AS (SELECT o.*, (SELECT sum(c.p) FROM conv c WHERE c.query = o.query AND c.a = o.a AND c.b = o.b AND c.s <= o.steps) AS p_one FROM own o),
 best AS (SELECT *, count(*) OVER (PARTITION BY query, target) AS tried, row_number() OVER (PARTITION BY query, target ORDER BY round(p_one, 12), overlap DESC, strand, off) AS k FROM one)"""


@query("similar_motifs", f"{_ALIGNED} SELECT query, target, cast(off AS bigint) AS off, strand, overlap, round(distance, 6) AS distance, round(1-pow(1-least(p_one, 1-1e-15), tried), 6) AS p_value FROM best WHERE k = 1", "sequences", "motifs")
def similar_motifs(spark, d):
    """The fixed motifs against one of each language: shares of bases by place modulo 6."""
    places = T.sequences(spark, d).select("lang", F.posexplode(F.split("seq", "")).alias("i", "base")).groupBy("lang", (F.col("i") % 6).alias("pos")).agg(*[F.count_if(F.col("base") == b).alias(b) for b in "ACGT"])
    total = sum((F.col(b) for b in "CGT"), F.col("A")) + 4
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), ((F.col(b) + 1) / total).alias("prob")) for b in "ACGT"])).alias("x")
    targets = places.select(F.col("lang").alias("motif"), "pos", cells).select("motif", "pos", "x.base", "x.prob")
    made = motifs.motif_similarity(T.motifs(spark), targets)
    return made.select("query", "target", F.col("offset").alias("off"), "strand", "overlap", six("distance").alias("distance"), six("p_value").alias("p_value"))


# SQL of queries that the other module registers without it

ORACLES["similar_motifs"] = ORACLES["similar_motifs"].replace("WITH ", "WITH RECURSIVE ", 1)
_NAMED = f"WITH sequences AS ({T.SQL['sequences']}), motifs AS ({T.motifs_sql()})"
ORACLES["motif_sites"] = f"{_NAMED} {_TAILS} SELECT w.id, motif, cast(istart AS bigint) AS istart, cast(istart+6 AS bigint) AS iend, strand, round(score, 6) AS score, p AS p_value, substring(q.seq, cast(istart AS bigint)+1, 6) AS matched_seq FROM ({_SITES}) w JOIN sequences q ON q.id = w.id WHERE p < 0.001"
_LINEAR = ", r0 AS (SELECT 0 AS iter, id, -1 AS pos, '' AS allele, seq, {score} AS total_score FROM sequences WHERE length(seq) > 41), ".format(score=_score_sql("seq", "t1")) + ", ".join(_ROUND.format(i=i, j=i - 1, score=_score_sql("seq", "t1")) for i in (1, 2))
ORACLES["evolved"] = f"WITH sequences AS ({T.SQL['sequences']}) {_LINEAR} SELECT cast(iter AS integer) AS iter, id, cast(pos AS integer) AS pos, allele, seq, round(total_score, 6) AS total_score FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 WHERE (SELECT max(total_score) FROM r1) > (SELECT max(total_score) FROM r0))"
_ALT = "SELECT id, substring(seq, 1, (length(seq)-6)//2) || 'CACGTG' || substring(seq, (length(seq)-6)//2+7) AS seq FROM sequences WHERE length(seq) > 41"
_ALT_SITES = _SITES.replace("FROM sequences s", f"FROM ({_ALT}) s")
ORACLES["compared_motifs"] = f"""{_NAMED} {_TAILS} SELECT id, motif, cast(istart AS bigint) AS istart, cast(istart+6 AS bigint) AS iend, strand, round(a.score, 6) AS score_ref, round(b.score, 6) AS score_alt, a.p AS p_ref, b.p AS p_alt, round(b.score - a.score, 6) AS score_diff
 FROM ({_SITES}) a JOIN ({_ALT_SITES}) b USING (id, motif, strand, istart) WHERE (a.p < 0.001 OR b.p < 0.001) AND abs(a.score - b.score) > 1e-9"""
