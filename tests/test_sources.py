"""File readers and writers, and the running coverage of a stream."""

import gzip
import os

import pytest

from helixframe.plans import tables as T
from helixframe.sources import files
from helixframe.streaming.coverage import running_insertions

MEME = """MEME version 4

ALPHABET= ACGT

MOTIF one first
letter-probability matrix: alength= 4 w= 2 nsites= 20 E= 0
 0.2 0.8 0.0 0.0
 0.95 0.0 0.05 0.0
URL x

MOTIF two
letter-probability matrix: alength= 4 w= 1 nsites= 20 E= 0
 0.25 0.25 0.25 0.25
"""


def put(folder, name, text, how=open):
    path = os.path.join(folder, name)
    with how(path, "wt") as file:
        file.write(text)
    return path


def test_readers(spark, tmp_path):
    bed = files.read_bed(spark, put(tmp_path, "a.bed", "chr1\t0\t5\tx\nchr2\t3\t9\ty\n"))
    assert bed.columns == ["chrom", "start", "end", "_c3"] and bed.count() == 2
    peaks = files.read_narrowpeak(spark, put(tmp_path, "a.narrowPeak", "track type=narrowPeak\nchr1\t0\t5\tp\t10\t.\t1.5\t2\t3\t2\n"))
    assert [(r["chrom"], r["summit"]) for r in peaks.collect()] == [("chr1", 2)]
    for path in (put(tmp_path, "a.fa", ">s1 more\nAAC\nG\n\n>s2\nATG\n"), put(tmp_path, "b.fa.gz", ">s1\nAACG\n>s2\nAT\nG", gzip.open)):
        assert sorted(map(tuple, files.read_fasta(spark, path).collect())) == [("s1", "AACG"), ("s2", "ATG")]
    assert files.read_sizes(spark, put(tmp_path, "a.sizes", "chr1\t2000\n")).first()["size"] == 2000
    gtf = 'chr1\tx\tgene\t11\t20\t.\t+\t.\tgene_id "g1"; gene_name "N1";\nchr1\tx\texon\t11\t12\t.\t+\t.\tgene_id "g1";\n'
    assert [(r["start"], r["gene_name"]) for r in files.read_gtf(spark, put(tmp_path, "a.gtf", gtf), ["gene"]).collect()] == [(10, "N1")]
    motif = files.read_meme(spark, put(tmp_path, "a.meme", MEME))
    assert motif.count() == 12 and {r["motif"] for r in motif.select("motif").distinct().collect()} == {"one first", "two"}
    assert motif.filter("motif = 'one first' AND pos = 1 AND base = 'A'").first()["prob"] == 0.95
    head = "Query_ID\tTarget_ID\tOptimal_offset\tp-value\tE-value\tq-value\tOverlap\tQuery_consensus\tTarget_consensus\tOrientation\n"
    put(tmp_path, "neg.1.tomtom.tsv", head + "1\tT1\t0\t0.001\t0.1\t0.01\t5\tA\tC\t-\n1\tT2\t0\t0.5\t0.9\t0.6\t5\tA\tC\t-\n\n# end\n")
    assert [(r["Query_ID"], r["Target_ID"]) for r in files.read_matches(spark, str(tmp_path)).collect()] == [("neg.1", "T1")]


def test_writers(spark, tmp_path):
    runs = spark.createDataFrame([("chr1", 0, 5, 2.0), ("chr2", 1, 2, 1.0)], "chrom string, start long, end long, value double")
    files.write_bedgraph(runs, str(tmp_path / "g"))
    assert sorted(map(tuple, files.read_bedgraph(spark, str(tmp_path / "g")).collect())) == [("chr1", 0, 5, 2.0), ("chr2", 1, 2, 1.0)]
    files.write_table(runs, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("chrom = 'chr2'").count() == 1


def test_running_insertions(spark, tmp_path):
    schema = "chrom string, start long, end long"
    spark.createDataFrame([("chr1", 0, 3), ("chr1", 0, 9)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = running_insertions(stream).writeStream.outputMode("complete").format("memory").queryName("insertions").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("insertions").collect())) == [("chr1", 0, 2), ("chr1", 2, 1), ("chr1", 8, 1)]
    with pytest.raises(ValueError):
        running_insertions(spark.createDataFrame([("chr1", 0, 3)], schema))


def test_sql_names_its_tables():
    assert set(T.SQL) == {"intervals", "blacklist", "sequences", "matrix", "variants", "preds"}


def test_fasta_straight_into_chunks(spark, tmp_path):
    """Records over many splits and files, lines of any length, against records read whole."""
    import random

    from helixframe.operators import genome

    rng, want = random.Random(3), {}
    (tmp_path / "fa").mkdir()
    for f in range(2):
        lines = ["stray"] if f else []
        for i in range(6):
            name = f"c{f}_{i}"
            lines.append(f">{name} some > words")
            seq = "".join(rng.choice("acgtN") for _ in range(rng.choice([0, 1, 150, 2000])))
            want[name] = seq.upper()
            width = rng.choice([7, 60, 5000])
            lines += [seq[at : at + width] for at in range(0, len(seq), width)] + ([""] if i % 2 else [])
        (tmp_path / "fa" / f"{f}.fa").write_text("\n".join(lines) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = {}
        for r in files.read_fasta_chunks(spark, f"{tmp_path}/fa", 64).collect():
            got[r["chrom"], r["chunk_id"]] = r["bases"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {(n, i // 64): s[i : i + 64] for n, s in want.items() for i in range(0, len(s), 64)}
    records = spark.createDataFrame([(n, s) for n, s in want.items()], "name string, seq string")
    assert {tuple(r) for r in genome.genome_chunks(records, 64).collect()} == {(*k, v) for k, v in got.items()}
