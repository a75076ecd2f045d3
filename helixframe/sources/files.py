"""Readers of BED, narrowPeak, FASTA, size, GTF, MEME, match and bedGraph files, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NARROWPEAK = "chrom string, start long, end long, name string, score double, strand string, signal double, p_value double, q_value double, summit long"


def _tab(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(path, sep="\t", **options)


def read_bed(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """chrom, start, end, then further columns under their names, or _c3 and so on."""
    df = _tab(spark, path, header=header, comment="#")
    names = df.columns
    return df.select(F.col(f"`{names[0]}`").alias("chrom"), F.col(f"`{names[1]}`").cast("long").alias("start"), F.col(f"`{names[2]}`").cast("long").alias("end"), *[F.col(f"`{n}`") for n in names[3:]])


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    """Ten named columns; track and comment lines are left out."""
    return _tab(spark, path, schema=NARROWPEAK, comment="#").filter(~F.col("chrom").rlike("^(track|browser)"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq), plain or gzip; the name is what stands before the first space of a line that
    begins with ">". Such signs elsewhere in a line are part of it. A record, as a chromosome, is one row."""
    records = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    # only the file's first record still has its sign
    own = F.regexp_replace("value", r"^\s*>", "")
    head = F.substring_index(own, "\n", 1)
    body = F.substring(own, F.length(head) + 1, F.length(own))
    return records.select(F.trim(F.regexp_replace(F.split(head, r"\s+")[0], "\r", "")).alias("name"), F.regexp_replace(body, r"\s+", "").alias("seq"))


def read_fasta_chunks(spark: SparkSession, path: str, chunk: int = 4096) -> DataFrame:
    """(chrom, chunk_id, bases), as ``genome.genome_chunks`` gives, without a row that holds a whole record.

    Files are read by lines, in as many splits as Spark makes of them. A split's lines are numbered within it; how many
    letters and which record stand before a split comes from one row for each split, added up. So each line knows its
    record and its place in it, is cut at the chunks' borders, and a chunk's pieces are put in order. No row is longer
    than a line or a chunk, no window larger than a split. Letters are made upper case; the name is what stands
    before the first space; lines before the first record, and records without letters, give nothing.
    """
    lines = spark.read.text(path).select(F.rtrim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    head = F.col("line").startswith(">")
    name = F.when(head, F.split(F.substring(F.col("line"), F.lit(2), F.length("line")), r"\s+")[0])
    lines = lines.withColumn("name", name).withColumn("n", F.when(head, 0).otherwise(F.length("line")).cast("long"))
    inside = Window.partitionBy("file", "split").orderBy("at")
    before = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("before", F.coalesce(before, F.lit(0)))
    # the record that a line is in, and how many letters of the split stand before that record
    record = F.last(F.when(F.col("name").isNotNull(), F.struct("name", "before")), ignorenulls=True)
    lines = lines.withColumn("own", record.over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    splits = lines.groupBy("file", "split").agg(F.sum("n").alias("letters"), F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("last"))
    ahead = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("ahead", F.coalesce(F.sum("letters").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opened = F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("last.name").alias("name"), (F.col("ahead") + F.col("last.before")).alias("at"))), ignorenulls=True)
    splits = splits.withColumn("open", opened.over(ahead.rowsBetween(Window.unboundedPreceding, -1))).select("file", "split", "ahead", "open")
    placed = lines.filter("n > 0").join(splits, ["file", "split"])
    start = F.when(F.col("own").isNotNull(), F.col("before") - F.col("own.before")).otherwise(F.col("ahead") + F.col("before") - F.col("open.at"))
    placed = placed.select(F.coalesce("own.name", "open.name").alias("chrom"), start.alias("pos"), "line", "n").filter("chrom IS NOT NULL")
    cut = placed.select("chrom", "pos", "line", "n", F.explode(F.sequence(F.floor(F.col("pos") / chunk), F.floor((F.col("pos") + F.col("n") - 1) / chunk))).alias("chunk_id")).withColumn("chunk_id", F.col("chunk_id").cast("int"))
    low = F.greatest(F.col("chunk_id").cast("long") * chunk - F.col("pos"), F.lit(0))
    high = F.least((F.col("chunk_id").cast("long") + 1) * chunk - F.col("pos"), F.col("n"))
    pieces = cut.select("chrom", "chunk_id", F.struct((F.col("pos") + low).alias("pos"), F.upper(F.substring("line", (low + 1).cast("int"), (high - low).cast("int"))).alias("bases")).alias("piece"))
    joined = pieces.groupBy("chrom", "chunk_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return joined.select("chrom", "chunk_id", F.array_join(F.transform("pieces", lambda x: x["bases"]), "").alias("bases"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _tab(spark, path, schema="chrom string, size long")


def load_blacklist(spark: SparkSession, genome: str, folder: str) -> DataFrame:
    """The blacklist of a genome by its name: the file ``<genome>-blacklist*.bed`` (or gzip) of a folder of
    public BED files; an unknown genome is refused by the reader, as no file is found."""
    if not genome.replace("_", "").replace(".", "").isalnum():
        raise ValueError("a genome's name has letters, digits, dots and underscores only")
    return read_bed(spark, f"{folder.rstrip('/')}/{genome}-blacklist*.bed*")


def read_gtf(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """chrom, start (0-based), end, strand, feature, source, gene_name, gene_id, attributes."""
    raw = _tab(spark, path, schema="chrom string, source string, feature string, first long, end long, score string, strand string, frame string, attributes string", comment="#", quote="")
    if features is not None:
        raw = raw.filter(F.col("feature").isin(list(features)))
    of = lambda key: F.nullif(F.regexp_extract("attributes", f'{key} "([^"]*)"', 1), F.lit(""))
    return raw.select("chrom", (F.col("first") - 1).alias("start"), "end", "strand", "feature", "source", of("gene_name").alias("gene_name"), of("gene_id").alias("gene_id"), "attributes")


def read_meme(spark: SparkSession, path: str, n_motifs: int | None = None) -> DataFrame:
    """(motif, pos, base, prob) of a MEME file, of its first ``n_motifs`` if asked; the motif's name is
    all that its line says."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^MOTIF\s+")).alias("i", "body")).filter("i > 0")
    if n_motifs is not None:
        whole = whole.filter(F.col("i") <= n_motifs)
    named = whole.select(F.trim(F.substring_index("body", "\n", 1)).alias("motif"), F.split(F.regexp_extract("body", r"letter-probability matrix[^\n]*\n((?:\s*[0-9.eE+-]+[ \t]+[0-9.eE+-]+[ \t]+[0-9.eE+-]+[ \t]+[0-9.eE+-]+[ \t\r]*\n?)+)", 1), "\n").alias("lines"))
    rows = named.select("motif", F.posexplode(F.filter("lines", lambda x: F.trim(x) != "")).alias("pos", "line"))
    cells = rows.select("motif", "pos", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("at", "prob"))
    return cells.select("motif", "pos", F.substring(F.lit("ACGT"), F.col("at") + 1, F.lit(1)).alias("base"), F.col("prob").cast("double").alias("prob"))


def read_matches(spark: SparkSession, folder: str, q_at_most: float = 0.05) -> DataFrame:
    """All motif match tables (*tomtom.tsv) of a folder; the query's name is its file's."""
    raw = _tab(spark, f"{folder.rstrip('/')}/*tomtom.tsv", header=True, comment="#")
    names = {c: c.replace("-", "_") for c in raw.columns}
    df = raw.withColumnsRenamed(names).withColumn("Query_ID", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.tomtom\.tsv$", ""))
    return df.dropna().withColumns({c: F.col(c).cast("double") for c in ("p_value", "E_value", "q_value")}).filter(F.col("q_value") <= q_at_most)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return _tab(spark, path, schema="chrom string, start long, end long, value double", comment="#").filter(~F.col("chrom").rlike("^(track|browser)"))


def write_table(df: DataFrame, path: str, by: str = "chrom", mode: str = "error") -> None:
    """Parquet with a folder for each value of ``by``, which later reads prune on."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_bedgraph(runs: DataFrame, path: str, partitions: int | None = None) -> None:
    """Tab-separated runs in genome order, in as many files as there are partitions."""
    order = ("chrom", "start")
    dealt = runs.repartitionByRange(partitions, *order) if partitions else runs.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("chrom", "start", "end", "value").write.csv(path, sep="\t")
