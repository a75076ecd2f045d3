"""Registered queries over the derived tables, each with the same thing said in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import coverage, expand, genome, intervals as I, matrix as M, metrics, motifs, scoring, variants as V, windows
from helixframe.plans import tables as T
from helixframe.scratch import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Weights of the linear base scorers.
TASKS = {"t1": {"A": 0.5, "C": 1.0, "G": 2.0, "T": 3.0}, "t2": {"A": 1.0, "C": 3.0, "G": 1.5, "T": 0.25}}


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a function as a query; ``tables`` are derivations that its SQL names."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql is not None:
            named = ", ".join(f"{t} AS ({T.motifs_sql() if t == 'motifs' else T.SQL[t]})" for t in tables)
            ORACLES[name] = f"WITH {named} {sql}" if named else sql
        return function

    return register


def six(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def _score_sql(seq: str, task: str) -> str:
    w = TASKS[task]
    return "(" + " + ".join(f"(length({seq})-length(replace({seq},'{b}','')))*{w[b]}::double" for b in sorted(w)) + f")/length({seq})"


def _out(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "istart", "end": "iend"})


# intervals

_OVER = "a.istart < b.iend + {w} AND a.iend > b.istart - {w}"


@query("blacklist_then_merge", f"""SELECT chrom, count(*) AS n, cast(min(istart) AS bigint) AS istart, cast(max(iend) AS bigint) AS iend FROM intervals a
 WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE a.chrom = b.chrom AND {_OVER.format(w=0)}) GROUP BY chrom""", "intervals", "blacklist")  # fmt: skip
def blacklist_then_merge(spark, d):
    kept = I.filter_blacklist(T.intervals(spark, d), T.blacklist(spark, d))
    merged, _ = I.merge_intervals_by_column(kept.drop("strand").withColumn("g", F.col("chrom")), "g", "n")
    return _out(merged.select("chrom", "n", "start", "end"))


@query("overlap_any", f"SELECT id, chrom, cast(istart AS bigint) AS istart, cast(iend AS bigint) AS iend FROM intervals a WHERE EXISTS (SELECT 1 FROM blacklist b WHERE a.chrom = b.chrom AND {_OVER.format(w=500)})", "intervals", "blacklist")
def overlap_any(spark, d):
    return _out(I.filter_overlapping(T.intervals(spark, d), T.blacklist(spark, d), window=500).drop("strand"))


@query("overlap_all", "SELECT id FROM intervals a WHERE EXISTS (SELECT 1 FROM blacklist b WHERE a.chrom = b.chrom AND a.istart >= b.istart AND a.iend <= b.iend)", "intervals", "blacklist")
def overlap_all(spark, d):
    return I.filter_overlapping(T.intervals(spark, d), T.blacklist(spark, d), method="all").select("id")


@query("overlap_invert", f"SELECT id FROM intervals a WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE a.chrom = b.chrom AND {_OVER.format(w=100)})", "intervals", "blacklist")
def overlap_invert(spark, d):
    return I.filter_blacklist(T.intervals(spark, d), T.blacklist(spark, d), window=100).select("id")


@query("variants_blacklist", "SELECT id FROM (SELECT id, chrom, pos-1 AS istart, pos AS iend FROM variants) a WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE a.chrom = b.chrom AND a.istart < b.iend AND a.iend > b.istart)", "variants", "blacklist")
def variants_blacklist(spark, d):
    return I.filter_blacklist(V.variants_to_intervals(T.variants(spark, d), 1), T.blacklist(spark, d)).select("id")


@query("filter_chromosomes", "SELECT id, chrom FROM intervals WHERE chrom NOT IN ('chr10','chr11')", "intervals")
def filter_chromosomes(spark, d):
    return I.filter_chromosomes(T.intervals(spark, d), "autosomes", ["chr10", "chr11"]).select("id", "chrom")


@query("chromosome_set", "SELECT DISTINCT chrom FROM intervals WHERE regexp_matches(chrom, '^chr[0-9]+$')", "intervals")
def chromosome_set(spark, d):
    return I.chromosome_set(T.intervals(spark, d).select("chrom").distinct())


@query("chrom_ends", "SELECT id, istart >= 500 AND iend <= 1001500 AS inside, istart < 0 OR iend > 1002000 AS outside FROM (SELECT id, istart-300 AS istart, iend+1000 AS iend FROM intervals)", "intervals")
def chrom_ends(spark, d):
    wide = T.intervals(spark, d).withColumn("start", F.col("start") - 300).withColumn("end", F.col("end") + 1000)
    inside = I.filter_chrom_ends(wide, T.sizes(spark), 500).select("id", F.lit(True).alias("inside"))
    outside = I.check_chrom_ends(wide, T.sizes(spark)).select("id", F.lit(True).alias("outside"))
    return wide.select("id").join(inside, "id", "left").join(outside, "id", "left").fillna(False)


@query("resize_clip_expand", """SELECT id, cast(ceil((istart+iend)/2.0-100) AS bigint) AS s_both, iend-200 AS s_left, istart AS s_right,
 greatest(istart,1000) AS s_clip, least(iend,900000) AS e_clip, istart-50 AS s_pad, iend+50 AS e_pad, istart+120-100 AS s_summit FROM intervals""", "intervals")  # fmt: skip
def resize_clip_expand(spark, d):
    df = T.intervals(spark, d).withColumn("s0", F.col("start")).withColumn("e0", F.col("end")).withColumn("summit", F.lit(120))
    df = I.resize_intervals(df, 200).withColumnRenamed("start", "s_both")
    for name, edit, column in (("s_left", lambda x: I.resize_intervals(x, 200, "left"), "start"), ("s_right", lambda x: I.resize_intervals(x, 200, "right"), "start"), ("s_clip", lambda x: I.clip_intervals(x, 1000), "start"), ("e_clip", lambda x: I.clip_intervals(x, None, 900000), "end"), ("s_pad", lambda x: I.expand_intervals(x, 50), "start"), ("e_pad", lambda x: I.expand_intervals(x, 50), "end"), ("s_summit", lambda x: I.extend_from_coord(x, 200), "start")):
        df = edit(df.withColumn("start", F.col("s0")).withColumn("end", F.col("e0"))).withColumn(name, F.col(column))
    return df.select("id", "s_both", "s_left", "s_right", "s_clip", "e_clip", "s_pad", "e_pad", "s_summit")


@query("interval_bins", """SELECT id, cast(floor((istart-100)/128.0-2) AS bigint) AS start_bin, cast(floor((iend-100)/128.0-2) AS bigint)+1 AS end_bin,
 floor((istart-100)/128.0-2) < 0 OR floor((iend-100)/128.0-2)+1 > 7000 AS out_of_range, (cast(floor((istart-100)/128.0-2) AS bigint)+2)*128+100 AS back FROM intervals""", "intervals")  # fmt: skip
def interval_bins(spark, d):
    df = I.intervals_to_bins(T.intervals(spark, d), 100, 128, 2, 7000)
    return df.select("id", "start_bin", "end_bin", "out_of_range", I.bin_to_coord(F.col("start_bin"), 100, 128, 2).alias("back"))


@query("selected_bins", "SELECT DISTINCT unnest(generate_series(cast(floor(istart/5000.0) AS bigint), cast(floor(iend/5000.0) AS bigint))) AS bin FROM intervals", "intervals")
def selected_bins(spark, d):
    return I.selected_bins(T.intervals(spark, d), 5000)


@query("tile_positions", "SELECT id, s AS tile_start, s-(length(seq)-6)//2 AS distance FROM sequences, generate_series(0, 400, 5) g(s) WHERE s <= length(seq)-10 AND (s+10 <= (length(seq)-6)//2 OR s >= (length(seq)-6)//2+6)", "sequences")
def tile_positions(spark, d):
    return I.tile_positions(T.sequences(spark, d), F.length("seq"), 10, 5, 6).select("id", F.col("tile_start").cast("long").alias("tile_start"), F.col("distance").cast("long").alias("distance"))


@query("split_by_chromosome", "SELECT id, CASE WHEN chrom='chr10' THEN 'val' WHEN chrom='chr11' THEN 'test' ELSE 'train' END AS split FROM intervals", "intervals")
def split_by_chromosome(spark, d):
    return I.split(T.intervals(spark, d)).select("id", "split")


@query("add_negatives", "SELECT id, chrom, is_negative, label FROM (SELECT id, chrom, false AS is_negative, 1.0::double AS label FROM intervals UNION ALL SELECT id, chrom, true, 0.0::double FROM blacklist)", "intervals", "blacklist")
def add_negatives(spark, d):
    return I.add_negatives(T.intervals(spark, d).withColumn("label", F.lit(1.0)), T.blacklist(spark, d)).select("id", "chrom", "is_negative", "label")


#: A third of the intervals in groups of one chromosome and strand, the others in groups of any.
_GROUP = "CASE WHEN id % 3 = 0 THEN chrom || strand || (id % 7) ELSE 'g' || (id % 1000) END"


@query("merge_by_group", f"""SELECT g, CASE WHEN one THEN chrom ELSE '' END AS chrom, CASE WHEN one THEN istart ELSE -1 END AS istart, CASE WHEN one THEN iend ELSE -1 END AS iend, NOT one AS conflicts FROM (
 SELECT {_GROUP} AS g, min(chrom) AS chrom, cast(min(istart) AS bigint) AS istart, cast(max(iend) AS bigint) AS iend, count(DISTINCT chrom) = 1 AND count(DISTINCT strand) = 1 AS one FROM intervals GROUP BY 1)""", "intervals")  # fmt: skip
def merge_by_group(spark, d):
    group = F.when(F.col("id") % 3 == 0, F.concat("chrom", "strand", (F.col("id") % 7).cast("string"))).otherwise(F.concat(F.lit("g"), (F.col("id") % 1000).cast("string")))
    merged, conflicts = I.merge_intervals_by_column(T.intervals(spark, d).withColumn("g", group), "g")
    both = merged.select("g", "chrom", "start", "end").withColumn("conflicts", F.lit(False)).unionByName(conflicts.withColumn("conflicts", F.lit(True)), allowMissingColumns=True)
    return _out(both.fillna("", "chrom").fillna(-1, ["start", "end"]))


def _draw(seed: int, key: str) -> str:
    """``hashed_order`` in SQL."""
    return f"('0x' || substring(md5('{seed}:' || {key}), 1, 15))::BIGINT"


@query("sample_intervals", f"SELECT id, chrom, istart, iend, strand FROM intervals ORDER BY {_draw(3, 'id')}, id LIMIT 500", "intervals")
def sample_intervals(spark, d):
    return _out(I.sample_n(T.intervals(spark, d), 500, seed=3))


# sequences


@query("sequence_functions", """SELECT id, reverse(translate(seq,'ACGTN','TGCAN')) AS rc, round((length(seq)-length(translate(seq,'GC','')))/length(seq)::double, 6) AS gc,
 regexp_matches(seq,'^[ACGTN]*$') AS valid, length(seq) AS n, length(seq)-length(replace(seq,'C','')) AS n_c FROM sequences""", "sequences")  # fmt: skip
def sequence_functions(spark, d):
    seq = F.col("seq")
    return T.sequences(spark, d).select("id", S.reverse_complement(seq).alias("rc"), six(S.gc_fraction(seq)).alias("gc"), S.valid_dna(seq).alias("valid"), F.length(seq).cast("long").alias("n"), S.count_overlapping(seq, "C").cast("long").alias("n_c"))


@query("sequence_resize", """SELECT id, CASE WHEN length(seq) < 100 THEN repeat('N', ((100-length(seq))//2)::int) || seq || repeat('N', (100-length(seq)-(100-length(seq))//2)::int)
 ELSE substring(seq, ((length(seq)-100)//2)+1, 100) END AS both_ends, CASE WHEN length(seq) <= 40 THEN seq ELSE substring(seq, length(seq)-39, 40) END AS cut_left, seq || repeat('N', greatest(400-length(seq), 0)::int) AS padded FROM sequences""", "sequences")  # fmt: skip
def sequence_resize(spark, d):
    seq = F.col("seq")
    return T.sequences(spark, d).select("id", S.resize(seq, 100).alias("both_ends"), S.trim(seq, 40, "left").alias("cut_left"), S.pad(seq, 400, "right").alias("padded"))


@query("sequence_edits", """SELECT id, substring(seq,1,5) || 'TTT' || substring(seq,9) AS mutated, substring(seq,1,length(seq)//2) || 'CCC' || substring(seq,length(seq)//2+1) AS inserted,
 substring(seq,1,10) || substring(seq,14) || repeat('N', least(greatest(length(seq)-10, 0), 3)::int) AS padded_deletion FROM sequences""", "sequences")  # fmt: skip
def sequence_edits(spark, d):
    seq = F.col("seq")
    return T.sequences(spark, d).select("id", S.mutate(seq, F.lit("TTT"), 5).alias("mutated"), S.insert(seq, F.lit("CCC")).alias("inserted"), S.delete(seq, 3, 10, True, "right").alias("padded_deletion"))


@query("sequence_differences", "SELECT id, i-1 AS pos FROM sequences, generate_series(1, 400) g(i) WHERE i <= length(seq) AND substring(seq,i,1) <> substring(reverse(seq),i,1)", "sequences")
def sequence_differences(spark, d):
    found = T.sequences(spark, d).select("id", F.explode(S.differences(F.col("seq"), F.reverse("seq"))).alias("pos"))
    return found.select("id", F.col("pos").cast("long").alias("pos"))


@query("pattern_scores", """SELECT id, (SELECT count(*) FROM generate_series(1,400) g(i) WHERE substring(seq,i,2)='AA') * 1.0::double
 + (SELECT count(*) FROM generate_series(1,400) g(i) WHERE substring(seq,i,3)='TAT') * -0.5::double AS score FROM sequences""", "sequences")  # fmt: skip
def pattern_scores(spark, d):
    return T.sequences(spark, d).select("id", S.pattern_score(F.col("seq"), ["AA", "TAT"], [1, -0.5]).alias("score"))


@query("encoded_bases", "SELECT id, i-1 AS pos, strpos('ACGTN', substring(seq,i,1))-1 AS code FROM sequences, generate_series(1,400) g(i) WHERE i <= length(seq)", "sequences")
def encoded_bases(spark, d):
    df = T.sequences(spark, d).select("id", F.posexplode(S.encode(F.col("seq"))).alias("pos", "code"))
    return df.select("id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


@query("equal_lengths", "SELECT cast(min(length(seq)) AS bigint) AS shortest, cast(max(length(seq)) AS bigint) AS longest, min(length(seq)) = max(length(seq)) AS equal FROM sequences", "sequences")
def equal_lengths(spark, d):
    n = S.seq_length(F.col("seq")).cast("long")
    return T.sequences(spark, d).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), S.all_equal_length(F.col("seq")).alias("equal"))


# genome

_WINDOWS = "SELECT id, (id*37)%(length(seq)-30) AS istart, seq FROM sequences WHERE length(seq) > 41"


@query("window_sequences", f"SELECT id, CASE WHEN id%2=0 THEN reverse(translate(substring(seq,istart+1,25),'ACGTN','TGCAN')) ELSE substring(seq,istart+1,25) END AS seq FROM ({_WINDOWS})", "sequences")
def window_sequences(spark, d):
    seqs = _long(T.sequences(spark, d))
    chunks = genome.genome_chunks(seqs.select(F.concat(F.lit("doc"), "id").alias("name"), "seq"), T.CHUNK)
    return genome.intervals_to_sequences(T.windows(seqs), chunks, T.CHUNK)


@query("genome_chunks", "SELECT 'doc' || id AS chrom, c AS chunk_id, substring(seq,c*16+1,16) AS bases FROM sequences, generate_series(0,25) g(c) WHERE c <= (length(seq)-1)//16", "sequences")
def genome_chunks(spark, d):
    chunks = genome.genome_chunks(T.sequences(spark, d).select(F.concat(F.lit("doc"), "id").alias("name"), "seq"), T.CHUNK)
    return chunks.withColumn("chunk_id", F.col("chunk_id").cast("long"))


def _local_variants(seqs: DataFrame) -> DataFrame:
    """One substitution in each sequence, whose reference allele is right in two of three."""
    pos = (F.col("id") * 31) % (F.length("seq") - 40) + 20
    true = F.substring("seq", pos.cast("int"), F.lit(1))
    ref = F.when(F.col("id") % 3 == 0, F.lit("A")).otherwise(true)
    return seqs.select("id", F.concat(F.lit("doc"), "id").alias("chrom"), pos.alias("pos"), ref.alias("ref"), F.translate(true, "ACGT", "CGTA").alias("alt"))


_LOCAL = """SELECT id, seq, pos, CASE WHEN id%3=0 THEN 'A' ELSE substring(seq,pos,1) END AS ref, translate(substring(seq,pos,1),'ACGT','CGTA') AS alt
 FROM (SELECT id, seq, (id*31)%(length(seq)-40)+20 AS pos FROM sequences WHERE length(seq) > 41)"""


def _long(seqs: DataFrame) -> DataFrame:
    return seqs.filter(F.length("seq") > 41)


@query("check_reference", f"SELECT id, ref, substring(seq,pos,1) AS genome FROM ({_LOCAL}) WHERE ref <> substring(seq,pos,1)", "sequences")
def check_reference(spark, d):
    seqs = _long(T.sequences(spark, d))
    chunks = genome.genome_chunks(seqs.select(F.concat(F.lit("doc"), "id").alias("name"), "seq"), T.CHUNK)
    return genome.check_reference(_local_variants(seqs), chunks, T.CHUNK).select("id", "ref", "genome")


@query("variant_alleles", f"SELECT id, t AS allele_type, substring(seq,pos-9,9) || CASE t WHEN 'ref' THEN ref ELSE alt END || substring(seq,pos+1,10) AS seq FROM ({_LOCAL}), (VALUES ('ref'),('alt')) v(t)", "sequences")
def variant_alleles(spark, d):
    seqs = _long(T.sequences(spark, d))
    chunks = genome.genome_chunks(seqs.select(F.concat(F.lit("doc"), "id").alias("name"), "seq"), T.CHUNK)
    return V.variant_alleles(_local_variants(seqs), chunks, 20, T.CHUNK)


@query("variant_effects", f"""SELECT id, task, round(max(v) FILTER (t='alt') / max(v) FILTER (t='ref'), 6) AS effect FROM (
 SELECT id, t, task, CASE task WHEN 't1' THEN {_score_sql('s', 't1')} ELSE {_score_sql('s', 't2')} END AS v FROM (
 SELECT id, t, substring(seq,pos-9,9) || CASE t WHEN 'ref' THEN ref ELSE alt END || substring(seq,pos+1,10) AS s FROM ({_LOCAL}), (VALUES ('ref'),('alt')) v(t)), (VALUES ('t1'),('t2')) w(task)) GROUP BY id, task""", "sequences")  # fmt: skip
def variant_effects(spark, d):
    return scoring.allele_effects(scoring.score_linear(variant_alleles(spark, d), TASKS)).withColumn("effect", six("effect"))


@query("filter_variants", """SELECT id, ref, alt FROM variants WHERE regexp_matches(ref,'^([ACGT]+|-)$') AND regexp_matches(alt,'^([ACGT]+|-)$')
 AND (CASE WHEN alt='-' THEN 0 ELSE length(alt) END) - (CASE WHEN ref='-' THEN 0 ELSE length(ref) END) <= 0 AND (CASE WHEN ref='-' THEN 0 ELSE length(ref) END) - (CASE WHEN alt='-' THEN 0 ELSE length(alt) END) <= 0""", "variants")  # fmt: skip
def filter_variants(spark, d):
    return V.filter_variants(T.variants(spark, d)).select("id", "ref", "alt")


@query("variant_windows", "SELECT id, pos-10 AS istart, pos+10 AS iend FROM variants", "variants")
def variant_windows(spark, d):
    return _out(V.variants_to_intervals(T.variants(spark, d), 20).select("id", "start", "end"))


@query("variant_strings", "SELECT id, ref, alt FROM variants", "variants")
def variant_strings(spark, d):
    said = T.variants(spark, d).select("id", F.concat_ws(">", "ref", "alt").alias("v"))
    return V.split_variant_string(said, "v").select("id", "ref", "alt")


# coverage

_INSERT = "SELECT chrom, pos, count(*) AS depth FROM (SELECT chrom, istart+4 AS pos FROM intervals UNION ALL SELECT chrom, iend-5-1 FROM intervals) GROUP BY chrom, pos"


@query("insertion_counts", f"SELECT chrom, cast(pos AS bigint) AS pos, depth FROM ({_INSERT})", "intervals")
def insertion_counts(spark, d):
    return coverage.insertion_counts(T.intervals(spark, d), 4, -5)


@query("coverage_runs", f"""SELECT chrom, cast(min(pos) AS bigint) AS istart, cast(max(pos)+1 AS bigint) AS iend, min(depth) AS value FROM (
 SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(pos) OVER w = pos-1 AND lag(depth) OVER w = depth THEN 0 ELSE 1 END AS f
 FROM ({_INSERT}) WINDOW w AS (PARTITION BY chrom ORDER BY pos))) GROUP BY chrom, run""", "intervals")  # fmt: skip
def coverage_runs(spark, d):
    return _out(coverage.merge_runs(coverage.insertion_counts(T.intervals(spark, d), 4, -5), span=50_000))


@query("coverage_over_regions", f"""SELECT b.id, cast(coalesce(sum(depth),0) AS double) AS value FROM blacklist b LEFT JOIN ({_INSERT}) c ON b.chrom = c.chrom AND c.pos >= b.istart AND c.pos < b.iend GROUP BY b.id""", "intervals", "blacklist")
def coverage_over_regions(spark, d):
    regions = T.blacklist(spark, d)
    runs = coverage.merge_runs(coverage.insertion_counts(T.intervals(spark, d), 4, -5, within=regions))
    return coverage.coverage_over_intervals(regions, runs)


@query("coverage_extremes", f"""SELECT b.id, cast(coalesce(max(depth), 0) AS double) AS high, cast(CASE WHEN count(pos) < any_value(iend-istart) THEN 0 ELSE min(depth) END AS double) AS low
 FROM (SELECT id, chrom, (istart+iend)//2-10 AS istart, (istart+iend)//2-10+(id%25)+1 AS iend FROM blacklist) b LEFT JOIN ({_INSERT}) c ON b.chrom = c.chrom AND c.pos >= b.istart AND c.pos < b.iend GROUP BY b.id""", "intervals", "blacklist")  # fmt: skip
def coverage_extremes(spark, d):
    """Largest and smallest depth in stretches of 1 to 25 bases."""
    low = F.floor((F.col("start") + F.col("end")) / 2) - 10
    regions = T.blacklist(spark, d).select("id", "chrom", low.alias("start"), (low + F.col("id") % 25 + 1).alias("end"))
    runs = coverage.merge_runs(coverage.insertion_counts(T.intervals(spark, d), 4, -5, within=regions))
    high, least = (coverage.coverage_over_intervals(regions, runs, how).withColumnRenamed("value", name) for how, name in (("max", "high"), ("min", "low")))
    return high.join(least, "id")


@query("binned_signal", "SELECT id, task, pos//8 AS pos, round(avg(v),6) AS value FROM (SELECT id, 'gc' AS task, i-1 AS pos, CASE WHEN substring(seq,i,1) IN ('G','C') THEN 1.0 ELSE 0.0 END::double AS v FROM sequences, generate_series(1,400) g(i) WHERE i <= length(seq)) GROUP BY id, task, pos//8", "sequences")
def binned_signal(spark, d):
    bases = T.sequences(spark, d).select("id", F.posexplode(S.encode(F.col("seq"))).alias("pos", "code"))
    signal = bases.select("id", F.lit("gc").alias("task"), "pos", F.col("code").isin(1, 2).cast("double").alias("value"))
    return coverage.bin_signal(signal, 8, "mean").withColumn("value", six("value"))


# matrices

_TOTALS = "SELECT var, sum(value)/(SELECT count(DISTINCT obs) FROM matrix) AS total FROM matrix GROUP BY var"


@query("coverage_cutoff", f"SELECT var, round(total,6) AS total FROM ({_TOTALS}) WHERE total >= 5", "matrix")
def coverage_cutoff(spark, d):
    m = T.matrix(spark, d)
    return M.filter_coverage(m, m.select("obs").distinct().count(), "cutoff", 5).select("var", six("total").alias("total"))


@query("coverage_top", f"SELECT var, round(total,6) AS total FROM ({_TOTALS}) ORDER BY total DESC, var LIMIT 50", "matrix")
def coverage_top(spark, d):
    m = T.matrix(spark, d)
    return M.filter_coverage(m, m.select("obs").distinct().count(), "top", 50).select("var", six("total").alias("total"))


@query("coverage_percentile", f"SELECT var, round(total,6) AS total FROM ({_TOTALS}) WHERE total >= (SELECT quantile_cont(total, 0.9) FROM ({_TOTALS}))", "matrix")
def coverage_percentile(spark, d):
    m = T.matrix(spark, d)
    return M.filter_coverage(m, m.select("obs").distinct().count(), "percentile", 90).select("var", six("total").alias("total"))


@query("coverage_negatives", f"""SELECT var, round(total, 6) AS total, is_negative FROM (
 SELECT *, row_number() OVER (PARTITION BY is_negative ORDER BY {_draw(1, 'var')}, var) AS nth, count(*) FILTER (NOT is_negative) OVER () AS n_kept
 FROM (SELECT *, total < 5 AS is_negative FROM ({_TOTALS}))) WHERE NOT is_negative OR nth <= cast(floor(0.2::double * n_kept) AS bigint)""", "matrix")  # fmt: skip
def coverage_negatives(spark, d):
    m = T.matrix(spark, d)
    return M.filter_coverage(m, m.select("obs").distinct().count(), "cutoff", 5, negative_frac=0.2, seed=1).select("var", six("total").alias("total"), "is_negative")


@query("filter_cells", "SELECT obs, var, value FROM matrix WHERE obs IN (SELECT obs FROM matrix GROUP BY obs HAVING count(*) >= 500)", "matrix")
def filter_cells(spark, d):
    m = T.matrix(spark, d)
    return M.filter_cells(m.groupBy("obs").agg(F.count("*").alias("n_cells")), m, 500)[1].select("obs", "var", "value")


@query("matrix_profile", "SELECT var, count(*) AS n, round(count(*)/(SELECT count(DISTINCT obs) FROM matrix)::double, 6) AS fraction FROM matrix WHERE value > 0 GROUP BY var", "matrix")
def matrix_profile(spark, d):
    m = T.matrix(spark, d)
    return M.matrix_profile(m, "var", m.select("obs").distinct().count()).withColumn("fraction", six("fraction"))


@query("dummies", "SELECT id, lang = c AS value, c AS class FROM sequences, (SELECT DISTINCT lang AS c FROM sequences)", "sequences")
def dummies(spark, d):
    return metrics.class_indicators(T.sequences(spark, d), "lang").select("id", "value", "class")


@query("melted_scores", f"SELECT id, 't1' AS variable, round({_score_sql('seq', 't1')},6) AS value FROM sequences UNION ALL SELECT id, 't2', round({_score_sql('seq', 't2')},6) FROM sequences", "sequences")
def melted_scores(spark, d):
    wide = T.sequences(spark, d).select("id", *[six(scoring.linear_score(F.col("seq"), w)).alias(t) for t, w in TASKS.items()])
    return wide.unpivot("id", list(TASKS), "variable", "value")


# expansion


@query("augmented", "SELECT id, s AS seq_shift, rc, CASE WHEN rc THEN reverse(translate(substring(seq,s+1,length(seq)-2),'ACGTN','TGCAN')) ELSE substring(seq,s+1,length(seq)-2) END AS seq FROM sequences, generate_series(0,2) g(s), (VALUES (false),(true)) v(rc) WHERE length(seq) > 2", "sequences")
def augmented(spark, d):
    return expand.augment(T.sequences(spark, d).select("id", "seq").filter(F.length("seq") > 2), F.length("seq") - 2, True, 1).select("id", F.col("seq_shift").cast("long").alias("seq_shift"), "rc", "seq")


@query("ism_mutants", "SELECT id, p-1 AS pos, b AS base, substring(seq,1,p-1) || b || substring(seq,p+1) AS seq FROM sequences, generate_series(1,400) g(p), (VALUES ('A'),('C'),('G'),('T')) v(b) WHERE p <= length(seq) AND id % 50 IS NOT NULL AND b <> substring(seq,p,1)", "sequences")
def ism_mutants(spark, d):
    return expand.saturation_mutants(T.sequences(spark, d).select("id", "seq"), drop_ref=True).withColumn("pos", F.col("pos").cast("long"))


@query("ism_scores", f"""SELECT id, p-1 AS pos, b AS base, round({_score_sql("(substring(seq,1,p-1) || b || substring(seq,p+1))", 't1')} - {_score_sql('seq', 't1')}, 6) AS effect FROM sequences, generate_series(1,400) g(p), (VALUES ('A'),('C'),('G'),('T')) v(b) WHERE p <= length(seq)""", "sequences")
def ism_scores(spark, d):
    # rounded where an effect is made, not in each row
    made = scoring.ism_scores(T.sequences(spark, d).select("id", "seq"), {"t1": TASKS["t1"]}, lambda value, own: six(value - own))
    return made.select("id", F.col("pos").cast("long").alias("pos"), "base", "effect")


@query("pattern_scan", "SELECT id, p AS pos, x AS pattern, substring(seq,1,p) || x || substring(seq,p+length(x)+1) AS seq FROM sequences, generate_series(0,400) g(p), (VALUES ('CACGTG'),('TTT')) v(x) WHERE p <= length(seq)-6", "sequences")
def pattern_scan(spark, d):
    return expand.pattern_scan(T.sequences(spark, d).select("id", "seq"), ["CACGTG", "TTT"]).withColumn("pos", F.col("pos").cast("long"))


@query("dinucleotides_of_shuffles", """SELECT id, s AS shuffle, substring(seq,i,2) AS pair, count(*) AS n FROM sequences, generate_series(0,1) h(s), generate_series(1,399) g(i) WHERE i < length(seq) GROUP BY id, s, substring(seq,i,2)""", "sequences")
def dinucleotides_of_shuffles(spark, d):
    made = expand.dinuc_shuffle(T.sequences(spark, d).select("id", "seq").filter(F.length("seq") > 1), 2, 5)
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - 1), lambda i: F.substring(F.col("seq"), i, F.lit(2)))).alias("pair")
    return made.select("id", F.col("shuffle").cast("long").alias("shuffle"), pairs).groupBy("id", "shuffle", "pair").agg(F.count("*").alias("n"))


@query("pattern_spacing", """SELECT id, tile_start, CASE WHEN tile_start IS NULL THEN f ELSE substring(f,1,tile_start) || 'TTT' || substring(f,tile_start+4) END AS seq FROM (
 SELECT id, (length(seq)-4)//2 AS m, substring(seq,1,(length(seq)-4)//2) || 'CCCC' || substring(seq,(length(seq)-4)//2+5) AS f FROM sequences WHERE length(seq) >= 20),
 (SELECT NULL::bigint AS tile_start UNION ALL SELECT s FROM generate_series(0,400,3) g(s)) WHERE tile_start IS NULL OR (tile_start <= length(f)-3 AND (tile_start+3 <= m OR tile_start >= m+4))""", "sequences")  # fmt: skip
def pattern_spacing(spark, d):
    seqs = T.sequences(spark, d).select("id", "seq").filter(F.length("seq") >= 20)
    return expand.pattern_spacing(seqs, "CCCC", "TTT", F.length("seq"), 3, 0).select("id", F.col("tile_start").cast("long").alias("tile_start"), "seq")


@query("pattern_marginalized")
def pattern_marginalized(spark, d):
    shuffled = expand.dinuc_shuffle(T.sequences(spark, d).select("id", "seq"), 3, 1)
    made = scoring.pattern_moments(shuffled, ["CACGTG"], scoring.linear_scorer(TASKS))
    return made.select("id", "task", six("background_mean").alias("effect"))


@query("variant_significance")
def variant_significance(spark, d):
    alleles = variant_alleles(spark, d)
    effects = scoring.allele_effects(scoring.score_linear(alleles, TASKS), "log2FC")
    seqs = _long(T.sequences(spark, d))
    chunks = genome.genome_chunks(seqs.select(F.concat(F.lit("doc"), "id").alias("name"), "seq"), T.CHUNK)
    own = _local_variants(seqs)
    base = own.select("id", "ref", "alt").join(genome.intervals_to_sequences(V.variants_to_intervals(own, 20), chunks, T.CHUNK), "id")
    moments = scoring.variant_moments(expand.dinuc_shuffle(base, 10, 2), scoring.linear_scorer(TASKS), "log2FC")
    return scoring.against_moments(effects, moments).select("id", "task", *[six(c).alias(c) for c in ("effect", "background_mean", "background_sd", "z", "p_value")])


@query("tile_shuffle_effects")
def tile_shuffle_effects(spark, d):
    seqs = T.sequences(spark, d).select("id", "seq", scoring.linear_score(F.col("seq"), TASKS["t1"]).alias("own"))
    made = scoring.score_linear(expand.tile_shuffles(seqs, 50, F.length("seq"), 25, 6, 2, 3), {"t1": TASKS["t1"]})
    return made.groupBy("id", "tile_start").agg(six(F.avg(F.col("value") - F.col("own"))).alias("effect"))


@query("random_mutants", f"""SELECT id, substring(seq, 1, p) || base || substring(seq, p+2) AS seq, cast(p AS integer) AS pos, base FROM (
 SELECT id, seq, p, list_filter(['A','C','G','T'], lambda b: b <> seq[p+1])[({_draw(5, 'id')}) % 3 + 1] AS base FROM (SELECT id, seq, ({_draw(4, 'id')}) % length(seq) AS p FROM sequences))""", "sequences")  # fmt: skip
def random_mutants(spark, d):
    return expand.random_mutants(T.sequences(spark, d).select("id", "seq"), 4)


@query("gc_matched", """SELECT bin, cast(least(want, have) AS bigint) AS n FROM (SELECT bin, count(*) FILTER (k) AS want, count(*) FILTER (NOT k) AS have FROM (
 SELECT id % 10 = 0 AS k, len(list_filter(range(0,10), lambda i: i*0.1::double <= (length(seq)-length(translate(seq,'GC','')))/length(seq)::double)) - 1 AS bin FROM sequences) GROUP BY bin) WHERE want > 0 AND have > 0""", "sequences")  # fmt: skip
def gc_matched(spark, d):
    seqs = T.sequences(spark, d).select("id", F.concat(F.lit("doc"), "id").alias("chrom"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), "seq")
    made = expand.gc_matched_negatives(seqs.filter("id % 10 = 0"), seqs.filter("id % 10 <> 0"), 0.1, 7)
    return made.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


_GENOME = "SELECT doc_id, concat('doc', doc_id) AS chrom, regexp_replace(upper(text),'[^ACGT]','','g') AS s FROM documents"
_GC10 = "len(list_filter(range(0,10), lambda i: i*0.1::double <= (length(x)-length(translate(x,'GC','')))/50.0::double)) - 1"


@query("gc_negatives_from_genome", f"""SELECT chrom, istart, bin FROM (SELECT w.*, want, row_number() OVER (PARTITION BY w.bin ORDER BY ('0x' || substring(md5('11:' || chrom || ':' || istart), 1, 15))::BIGINT, chrom, istart) AS nth
 FROM (SELECT chrom, istart, {_GC10} AS bin FROM (SELECT chrom, k*50 AS istart, substring(s, k*50+1, 50) AS x, doc_id % 10 = 0 AS has, (doc_id*37)%greatest(length(s)-49, 1) AS own, length(s) AS n
   FROM (SELECT *, unnest(range(0, length(s)//50)) AS k FROM ({_GENOME}))) WHERE NOT (has AND istart < own+50 AND istart+50 > own AND n >= 50)) w
 JOIN (SELECT bin, count(*) AS want FROM (SELECT {_GC10} AS bin FROM (SELECT substring(s, (doc_id*37)%(length(s)-49)+1, 50) AS x FROM ({_GENOME}) WHERE doc_id % 10 = 0 AND length(s) >= 50)) GROUP BY bin) USING (bin)) WHERE nth <= want""")  # fmt: skip
def gc_negatives_from_genome(spark, d):
    # the genome and the inputs are read in five passes
    letters = cut(T.letters(spark, d))
    chunks = genome.genome_chunks(letters.select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("s").alias("seq")), 64)
    start = (F.col("doc_id") * 37) % (F.length("s") - 49)
    inputs = letters.filter((F.col("doc_id") % 10 == 0) & (F.length("s") >= 50)).select(F.col("doc_id").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("chrom"), start.alias("start"), (start + 50).alias("end"))
    made = expand.genome_negatives(inputs, chunks, 50, 0.1, 11, chunk=64)
    return made.select("chrom", F.col("start").alias("istart"), F.col("bin").cast("long").alias("bin"))


# motifs

_ODDS = "SELECT motif, pos, base, log2((prob+0.0001)*4) AS score, '+' AS strand FROM motifs UNION ALL SELECT motif, 5-pos, translate(base,'ACGT','TGCA'), log2((prob+0.0001)*4), '-' FROM motifs"
_HITS = f"""SELECT id, motif, strand, istart, round(sum(score),5) AS score FROM (
 SELECT s.id, o.motif, o.strand, i-1-o.pos AS istart, o.score, length(seq) AS n FROM sequences s, generate_series(1,400) g(i) JOIN ({_ODDS}) o ON o.base = substring(s.seq,i,1) WHERE i <= length(s.seq))
 WHERE istart >= 0 AND istart + 6 <= n GROUP BY id, motif, strand, istart HAVING sum(score) > 7"""


@query("motif_hits", f"SELECT id, motif, strand, cast(istart AS bigint) AS istart, score FROM ({_HITS})", "sequences", "motifs")
def motif_hits(spark, d):
    found = motifs.scan_motifs(T.sequences(spark, d), T.motifs(spark), 1e-2).filter("score > 7")
    return found.select("id", "motif", "strand", F.col("start").alias("istart"), F.round("score", 5).alias("score"))


@query("motif_sites")
def motif_sites(spark, d):
    return _out(motifs.scan_motifs(T.sequences(spark, d), T.motifs(spark), 1e-3)).withColumn("score", six("score"))


@query("motif_scores", f"SELECT s.id, coalesce(sum(CASE motif WHEN 'MA0004.1 Arnt' THEN -1.0::double WHEN 'MA0006.1 Ahr::Arnt' THEN 0.5::double END), 0.0) AS motif_score FROM sequences s LEFT JOIN ({_HITS}) h ON s.id = h.id GROUP BY s.id", "sequences", "motifs")
def motif_scores(spark, d):
    seqs = T.sequences(spark, d)
    weights = spark.createDataFrame(list(zip(T.MOTIFS, (-1.0, 0.5))), "motif string, weight double")
    return motifs.motif_score(seqs, motifs.scan_motifs(seqs, T.motifs(spark), 1e-2).filter("score > 7"), weights)


@query("compared_motifs")
def compared_motifs(spark, d):
    pairs = _long(T.sequences(spark, d)).select("id", F.col("seq").alias("ref_seq"), S.mutate(F.col("seq"), F.lit("CACGTG")).alias("alt_seq"))
    made = motifs.compare_motifs(pairs, T.motifs(spark))
    return _out(made).withColumns({c: six(c) for c in ("score_ref", "score_alt", "score_diff")})


@query("site_attributions", f"SELECT id, motif, strand, cast(istart AS bigint) AS istart, round((SELECT sum(CASE substring(s.seq,cast(i AS bigint),1) WHEN 'G' THEN 2.0 WHEN 'C' THEN 1.0 ELSE 0.0 END) FROM generate_series(1,400) g(i) WHERE i > h.istart AND i <= h.istart+6)/24.0, 6)::double AS site_attr_score FROM ({_HITS}) h JOIN sequences s USING (id)", "sequences", "motifs")
def site_attributions(spark, d):
    seqs = T.sequences(spark, d)
    # the scan is written once, and what it found has the letters that are attributed
    sites = cut(motifs.scan_motifs(seqs, T.motifs(spark), 1e-2).filter("score > 7"))
    bases = sites.select("id", "start", F.posexplode(F.split("matched_seq", "")).alias("at", "base")).select("id", (F.col("start") + F.col("at")).alias("pos"), "base").distinct()
    attributions = bases.select("id", "pos", "base", F.when(F.col("base") == "G", 2.0).when(F.col("base") == "C", 1.0).otherwise(0.0).alias("value"))
    made = motifs.score_motif_match(motifs.score_sites(sites, attributions), attributions, T.motifs(spark))
    return made.select("id", "motif", "strand", F.col("start").alias("istart"), six("site_attr_score").alias("site_attr_score"))


# predictions

_BYTASK = "preds"


@query("mse_pearson_accuracy", "SELECT task, round(avg((pred-label)*(pred-label)),6) AS mse, round(corr(pred,label),6) AS pearson, round(avg(CASE WHEN (pred>0.5)=(label=1) THEN 1.0 ELSE 0.0 END),6) AS accuracy FROM preds GROUP BY task", "preds")
def mse_pearson_accuracy(spark, d):
    p = T.preds(spark, d)
    return metrics.task_metrics(p).select("task", *[six(c).alias(c) for c in ("mse", "pearson", "accuracy")])


_PR = """points AS (SELECT task, pred, sum(label) AS tp_own, count(*) AS n_own FROM preds GROUP BY task, pred),
 pr AS (SELECT *, sum(tp_own) OVER (PARTITION BY task ORDER BY pred DESC) AS tp, sum(n_own) OVER (PARTITION BY task ORDER BY pred DESC) AS n, sum(tp_own) OVER (PARTITION BY task) AS pos FROM points)"""


@query("precision_recall_metrics", f""", {_PR} SELECT task, round(max(2*(tp/n)*(tp/pos)/((tp/n)+(tp/pos)+1e-20)),6) AS best_f1, round(sum(tp/n*tp_own/pos),6) AS average_precision,
 round(sum((n_own-tp_own)*(tp-tp_own+tp_own/2.0))/(max(pos)*sum(n_own-tp_own)),6)::double AS auroc FROM pr GROUP BY task""", "preds")  # fmt: skip
def precision_recall_metrics(spark, d):
    return metrics.curve_metrics(T.preds(spark, d)).select("task", *[six(c).alias(c) for c in ("best_f1", "average_precision", "auroc")])


@query("calibration_curve", "SELECT task, cast(round_even(pred*10, 0) AS integer) AS tenth, round(avg(label),6) AS mean_label, count(*) AS n FROM preds GROUP BY ALL", "preds")
def calibration_curve(spark, d):
    return metrics.calibration_curve(T.preds(spark, d), True).select("task", "tenth", six("mean_label").alias("mean_label"), "n")


@query("losses", "SELECT round(avg(exp(pred)-label*pred),6) AS poisson, round(avg((pred-label)*(pred-label)),6) AS mse, round(avg(label*ln(1+exp(-pred)) + (1-label)*ln(1+exp(pred))),6) AS bce FROM preds", "preds")
def losses(spark, d):
    kinds = ("poisson", "mse", "bce")
    return metrics.evaluation_losses(T.preds(spark, d), kinds).select(*[six(k).alias(k) for k in kinds])


@query("prediction_distribution", "SELECT cast(least(floor(pred/0.05)+1, 21) AS bigint) AS bucket, count(*) AS n FROM preds GROUP BY 1", "preds")
def prediction_distribution(spark, d):
    return metrics.distribution(T.preds(spark, d), "pred", 0.0, 1.0, 20)


@query("box_statistics", "SELECT task, round(min(pred),6) AS low, round(quantile_cont(pred,0.25),6) AS q1, round(quantile_cont(pred,0.5),6) AS median, round(quantile_cont(pred,0.75),6) AS q3, round(max(pred),6) AS high FROM preds GROUP BY task", "preds")
def box_statistics(spark, d):
    return metrics.box_statistics(T.preds(spark, d), "pred", "task").select("task", *[six(c).alias(c) for c in ("low", "q1", "median", "q3", "high")])


def _dense(spark, d, last_first: bool = False):
    """Predictions of both tasks in the 5-letter places of each sequence: (id, task, pos, value, n), n places.
    Sums of doubles depend on the order of the places: the first first, or the last."""
    bounds = (F.lit(0), (F.ceil(F.length("seq") / 5) - 1).cast("int"))
    n = F.ceil(F.length("seq") / 5)
    parts = T.sequences(spark, d).select("id", n.alias("n"), "seq", F.explode(F.sequence(*(bounds[::-1] if last_first else bounds), F.lit(-1 if last_first else 1))).alias("pos"))
    return scoring.score_linear(parts.withColumn("seq", F.substring(F.col("seq"), 5 * F.col("pos") + 1, F.lit(5))), TASKS)


_PLACES = "SELECT id, i AS pos, (length(seq)+4)//5 AS n, substring(seq,5*i+1,5) AS p FROM sequences, generate_series(0,80) g(i) WHERE 5*i < length(seq)"
_DENSE = f"SELECT id, pos, n, 't1' AS task, {_score_sql('p', 't1')} AS value FROM ({_PLACES}) UNION ALL SELECT id, pos, n, 't2', {_score_sql('p', 't2')} FROM ({_PLACES})"


@query("aggregated_predictions", f"SELECT id, round(max(v)*-1,6) AS value FROM (SELECT id, task, sum(value) AS v FROM ({_DENSE}) WHERE pos IN (1,2,5) GROUP BY id, task) GROUP BY id", "sequences")
def aggregated_predictions(spark, d):
    return scoring.aggregate_predictions(_dense(spark, d), task="max", weight=-1, positions=[1, 2, 5]).withColumn("value", six("value"))


@query("specificity", f"SELECT id, round(o/(CASE WHEN f > 12 THEN 2*f ELSE f END),6) AS specificity FROM (SELECT id, sum(value) FILTER (task='t1') AS o, sum(value) FILTER (task='t2') AS f FROM ({_DENSE}) GROUP BY id)", "sequences")
def specificity(spark, d):
    # sums that are 12 by the numbers come out above or at 12 by their order; the SQL adds the last place first
    made = scoring.specificity(_dense(spark, d, True), ["t1"], ["t2"], off_weight=2, off_thresh=12)
    # and it rounds the number as it is held, where Spark's round takes its shortest decimal: 0.5046875 is below the half
    return made.withColumn("specificity", F.round(F.col("specificity") * 1e6) / 1e6)


@query("softmax", f"SELECT id, pos, task, round(exp(value)/sum(exp(value)) OVER (PARTITION BY id, pos),6) AS value FROM ({_DENSE})", "sequences")
def softmax(spark, d):
    return scoring.activation(_dense(spark, d), "softmax").select("id", F.col("pos").cast("long").alias("pos"), "task", six("value").alias("value"))


@query("averaged_strands", f"SELECT id, pos, task, round(avg(value),6) AS value FROM (SELECT id, pos, task, value FROM ({_DENSE}) UNION ALL SELECT id, n-1-pos, task, value+1 FROM ({_DENSE})) GROUP BY id, pos, task", "sequences")
def averaged_strands(spark, d):
    p = _dense(spark, d)
    # both strands of a sequence stand in one task, which puts them together before the shuffle
    both = p.withColumn("rc", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("value", F.when(F.col("rc"), F.col("value") + 1).otherwise(F.col("value")))
    return scoring.average_augmented(both, ["id"], F.col("n")).select("id", F.col("pos").cast("long").alias("pos"), "task", six("value").alias("value"))


@query("effects_by_position", f"SELECT pos, round(avg(value),6) AS mean, round(stddev_pop(value)/sqrt(count(*)),6) AS sem, count(*) AS n FROM ({_DENSE}) WHERE task='t1' GROUP BY pos", "sequences")
def effects_by_position(spark, d):
    p = _dense(spark, d).filter("task = 't1'").withColumnRenamed("value", "effect")
    return metrics.effect_by_position(p).select(F.col("pos").cast("long").alias("pos"), six("mean").alias("mean"), six("sem").alias("sem"), "n")


@query("ensemble_labels", f"SELECT id, pos, 'm_' || task AS task, round(value,6) AS pred, pos AS label FROM ({_DENSE}) WHERE pos IN (0,3)", "sequences")
def ensemble_labels(spark, d):
    p = _dense(spark, d).withColumn("pos", F.col("pos").cast("long"))
    e = scoring.ensemble_predictions({"m": p})
    return metrics.preds_with_labels(e, e.withColumn("value", F.col("pos")), [0, 3]).select("id", "pos", "task", six("pred").alias("pred"), "label")


@query("argmax_tasks", f"SELECT id, pos, CASE WHEN a >= b THEN 't1' ELSE 't2' END AS task FROM (SELECT id, pos, max(value) FILTER (task='t1') AS a, max(value) FILTER (task='t2') AS b FROM ({_DENSE}) GROUP BY id, pos)", "sequences")
def argmax_tasks(spark, d):
    made = metrics.argmax(_dense(spark, d).withColumn("at", F.struct("id", F.col("pos").cast("long").alias("pos"))), "value", "at")
    return made.select("at.id", "at.pos", "task")


@query("gc_histogram", "SELECT b AS bin, count(id) AS n FROM range(0,10) r(b) LEFT JOIN (SELECT id, len(list_filter(range(0,10), lambda i: i*0.1::double <= (length(seq)-length(translate(seq,'GC','')))/length(seq)::double)) - 1 AS bin FROM sequences) s ON s.bin = b GROUP BY b", "sequences")
def gc_histogram(spark, d):
    return metrics.gc_distribution(T.sequences(spark, d)).select(F.col("bin").cast("long").alias("bin"), "n")


@query("label_transforms", "SELECT obs, var, round(ln(least(greatest(value,2),40)),6) AS log_value, round(ln(1+least(greatest(value,2),40)),6) AS log1p_value FROM matrix", "matrix")
def label_transforms(spark, d):
    return T.matrix(spark, d).select("obs", "var", six(S.label_transform(F.col("value"), 2, 40, "log")).alias("log_value"), six(S.label_transform(F.col("value"), 2, 40, "log1p")).alias("log1p_value"))


@query("specific_ids", f"SELECT id, pos FROM (SELECT id, pos, avg(value-1.5) AS m, max(value-1.5) FILTER (task='t2') AS e FROM ({_DENSE}) GROUP BY id, pos) WHERE e < 0 AND m >= 0", "sequences")
def specific_ids(spark, d):
    effects = _dense(spark, d).withColumn("id", F.struct("id", F.col("pos").cast("long").alias("pos"))).withColumn("effect", F.col("value") - 1.5)
    return scoring.specific_effects(effects, "t2", 0, 0).select("id.id", "id.pos")


@query("evolved")
def evolved(spark, d):
    seqs = _long(T.sequences(spark, d)).select("id", "seq")
    made = scoring.evolve(seqs, TASKS["t1"], max_iter=2, by_counts=True)
    return made.select("iter", "id", "pos", "allele", "seq", six("total_score").alias("total_score"))


@query("coverage_windows", f"""SELECT b.id, t AS task, p AS pos, round(ln(1+least(coalesce((SELECT sum(depth) FROM c WHERE c.chrom = b.chrom AND c.pos >= b.s+p*250 AND c.pos < b.s+p*250+250), 0)*t, 30)), 6) AS value
 FROM (SELECT id, chrom, cast(ceil((istart+iend)/2.0-500) AS bigint) AS s FROM blacklist) b, generate_series(0,3) g(p), (VALUES (1),(2)) v(t)""", "intervals", "blacklist")  # fmt: skip
def coverage_windows(spark, d):
    runs = coverage.merge_runs(coverage.insertion_counts(T.intervals(spark, d), 4, -5))
    tracks = runs.withColumn("track", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.col("value") * F.col("track"))
    made = windows.coverage_windows(T.blacklist(spark, d), tracks, 1000, 250, high=30, transform="log1p")
    return made.select("id", "task", F.col("pos").cast("long").alias("pos"), six("value").alias("value"))


ORACLES["coverage_windows"] = ORACLES["coverage_windows"].replace(" SELECT b.id, t AS task", f", c AS ({_INSERT}) SELECT b.id, t AS task", 1)


@query("adjusted_p_values", """SELECT id, task, round(least(min(raw) OVER (PARTITION BY task ORDER BY pred DESC RANGE UNBOUNDED PRECEDING), 1), 6) AS q_value FROM (
 SELECT *, pred*count(*) OVER (PARTITION BY task)/count(*) OVER (PARTITION BY task ORDER BY pred RANGE UNBOUNDED PRECEDING) AS raw FROM preds)""", "preds")  # fmt: skip
def adjusted_p_values(spark, d):
    return motifs.fdr_bh(T.preds(spark, d), "pred", "task").select("id", "task", six("q_value").alias("q_value"))


@query("varying_tasks", f"SELECT task, round(var_samp(e),6) AS variance FROM (SELECT task, pos, avg(value) AS e FROM ({_DENSE}) GROUP BY task, pos) GROUP BY task", "sequences")
def varying_tasks(spark, d):
    effects = _dense(spark, d).withColumn("motif", F.col("pos")).withColumnRenamed("value", "effect")
    return scoring.tasks_by_variance(effects, 2).withColumn("variance", six("variance"))


@query("looked_up_tasks", f"SELECT id, pos, task, 'task ' || task AS name, round(value,6) AS value FROM ({_DENSE}) WHERE task <> 't2'", "sequences")
def looked_up_tasks(spark, d):
    p = _dense(spark, d)
    names = p.select("task").distinct().withColumn("name", F.concat(F.lit("task "), "task"))
    return scoring.task_lookup(p, names, names=["t2"], invert=True).select("id", F.col("pos").cast("long").alias("pos"), "task", "name", six("value").alias("value"))


@query("poisson_multinomial", f"""SELECT round(avg((tp - ty*ln(tp))/n - (y+1e-7)*ln((v+1e-7)/tp)), 4) AS loss FROM (
 SELECT value AS v, pos AS y, n, sum(value+1e-7) OVER (PARTITION BY id, task) AS tp, sum(pos+1e-7) OVER (PARTITION BY id, task) AS ty FROM ({_DENSE}))""", "sequences")  # fmt: skip
def poisson_multinomial(spark, d):
    p = _dense(spark, d).select("id", "task", "pos", "n", F.col("value").alias("pred"), F.col("pos").alias("label"))
    return metrics.poisson_multinomial_loss(p, F.col("n")).select(F.round("loss", 4).alias("loss"))


@query("gc_match_table", """SELECT kind, b AS bin, round(count(id)/max(n)::double, 6) AS n FROM (VALUES ('positive'),('negative')) k(kind) CROSS JOIN range(0,10) r(b)
 LEFT JOIN (SELECT id, CASE WHEN id%2=0 THEN 'positive' ELSE 'negative' END AS kd, len(list_filter(range(0,10), lambda i: i*0.1::double <= (length(seq)-length(translate(seq,'GC','')))/length(seq)::double)) - 1 AS bin FROM sequences) s ON s.bin = b AND s.kd = kind
 JOIN (SELECT CASE WHEN id%2=0 THEN 'positive' ELSE 'negative' END AS k2, count(*) AS n FROM sequences GROUP BY 1) t ON t.k2 = kind GROUP BY kind, b""", "sequences")  # fmt: skip
def gc_match_table(spark, d):
    seqs = T.sequences(spark, d)
    return metrics.gc_match_table(seqs.filter("id % 2 = 0"), seqs.filter("id % 2 = 1")).select("kind", F.col("bin").cast("long").alias("bin"), six("n").alias("n"))
