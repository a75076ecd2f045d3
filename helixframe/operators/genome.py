"""Sequences under intervals, from a genome cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.schema import INTERVALS, require_columns


def genome_chunks(records: DataFrame, chunk: int = 4096) -> DataFrame:
    """(chrom, chunk_id, bases) from (name, seq) rows."""
    last = F.floor((F.length("seq") - 1) / chunk).cast("int")
    cut = records.filter(F.length("seq") > 0).select(F.col("name").alias("chrom"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_id"), "seq")
    return cut.select("chrom", "chunk_id", F.upper(F.substring("seq", F.col("chunk_id") * chunk + 1, F.lit(chunk))).alias("bases"))


def genome_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("name").alias("chrom")).agg(F.sum(F.length("seq")).alias("size"))


def intervals_to_sequences(df: DataFrame, chunks: DataFrame, chunk: int = 4096) -> DataFrame:
    """(id, seq): the letters under each interval, reverse-complemented on strand "-".

    Intervals meet the chunks they touch by an equality join and get one piece from each; the
    pieces of an interval are put in order. An interval can't have more pieces than its length
    allows, so what is gathered for one is bounded by its own sequence.
    """
    require_columns(df, "id", *INTERVALS)
    stranded = df.withColumn("strand", F.col("strand") if "strand" in df.columns else F.lit("+"))
    touched = stranded.select("id", "chrom", "start", "end", "strand", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))).alias("chunk_id"))
    base = F.col("chunk_id") * chunk
    low, high = F.greatest(F.col("start") - base, F.lit(0)), F.least(F.col("end") - base, F.lit(chunk))
    pieces = touched.join(chunks, ["chrom", "chunk_id"]).select("id", "strand", F.struct("chunk_id", F.substring("bases", (low + 1).cast("int"), (high - low).cast("int")).alias("bases")).alias("piece"))
    joined = pieces.groupBy("id", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["bases"]), "").alias("seq"))
    return joined.select("id", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def tiled_counts(chunks: DataFrame, size: int, chunk: int = 4096) -> DataFrame:
    """(chrom, start, end, n_gc): every whole window of ``size`` letters, side by side from each chromosome's first
    letter, and its letters G and C.

    No window's letters are put together: a chunk is cut where windows end in it, each piece is counted, and
    counts are added up by window. A window of any length costs one number a chunk.
    """
    base = F.col("chunk_id").cast("long") * chunk
    last = base + F.length("bases") - 1
    pieces = chunks.filter(F.length("bases") > 0).select("chrom", "bases", base.alias("base"), F.explode(F.sequence(F.floor(base / size), F.floor(last / size))).alias("tile"))
    low = F.greatest(F.col("tile") * size - F.col("base"), F.lit(0))
    high = F.least((F.col("tile") + 1) * size - F.col("base"), F.length("bases"))
    piece = F.substring("bases", (low + 1).cast("int"), (high - low).cast("int"))
    counts = pieces.select("chrom", "tile", gc_count(piece).alias("n_gc"), (high - low).alias("n")).groupBy("chrom", "tile").agg(F.sum("n_gc").alias("n_gc"), F.sum("n").alias("n"))
    return counts.filter(F.col("n") == size).select("chrom", (F.col("tile") * size).alias("start"), ((F.col("tile") + 1) * size).alias("end"), "n_gc")


def interval_counts(df: DataFrame, chunks: DataFrame, chunk: int = 4096) -> DataFrame:
    """(id, n_gc, n): letters G and C under each interval, and the letters that the genome has there. An interval off
    the genome has no row."""
    touched = require_columns(df, "id", *INTERVALS).select("id", "chrom", "start", "end", F.explode(F.sequence(F.floor(F.greatest("start", F.lit(0)) / chunk), F.floor((F.col("end") - 1) / chunk))).alias("chunk_id"))
    base = F.col("chunk_id") * chunk
    low, high = F.greatest(F.col("start") - base, F.lit(0)), F.least(F.col("end") - base, F.lit(chunk))
    piece = F.substring("bases", (low + 1).cast("int"), (high - low).cast("int"))
    return touched.join(chunks, ["chrom", "chunk_id"]).groupBy("id").agg(F.sum(gc_count(piece)).alias("n_gc"), F.sum(F.length(piece)).alias("n"))


def check_reference(variants: DataFrame, chunks: DataFrame, chunk: int = 4096) -> DataFrame:
    """Variants whose reference allele is not what the genome has there; "-" is not checked."""
    taken = variants.filter("ref <> '-'")
    size = F.length("ref")
    windows = taken.select("id", "chrom", (F.col("pos") - F.ceil(size / 2)).alias("start"), (F.col("pos") - F.ceil(size / 2) + size).alias("end"))
    return taken.join(intervals_to_sequences(windows, chunks, chunk).withColumnRenamed("seq", "genome"), "id").filter("ref <> genome")
