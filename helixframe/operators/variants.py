"""Variants: cleaning, windows, alleles. Positions are 1-based; an absent allele is "-"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import mutate
from helixframe.operators.genome import intervals_to_sequences
from helixframe.schema import VARIANTS, require_columns


def _allele_length(allele: Column, absent: str) -> Column:
    return F.when(allele == absent, 0).otherwise(F.length(allele))


def filter_variants(df: DataFrame, standard_bases: bool = True, max_insert_len: int | None = 0, max_del_len: int | None = 0, absent: str = "-") -> DataFrame:
    """Variants of standard alleles whose insertion or deletion is short enough; None: any."""
    require_columns(df, *VARIANTS)
    if standard_bases:
        allele = f"^([ACGT]+|{absent})$"
        df = df.filter(F.col("ref").rlike(allele) & F.col("alt").rlike(allele))
    grown = _allele_length(F.col("alt"), absent) - _allele_length(F.col("ref"), absent)
    if max_insert_len is not None:
        df = df.filter(grown <= max_insert_len)
    return df if max_del_len is None else df.filter(-grown <= max_del_len)


def variants_to_intervals(df: DataFrame, seq_len: int = 1) -> DataFrame:
    start = F.col("pos") - F.ceil(F.lit(seq_len) / 2)
    return require_columns(df, *VARIANTS).withColumn("start", start).withColumn("end", F.col("start") + seq_len)


def split_variant_string(df: DataFrame, column: str, every: bool = False) -> DataFrame:
    """``ref`` and ``alt`` of strings like G>A,C: the first alternative, or a row for each."""
    parts = F.split(column, ">")
    alts = F.split(F.get(parts, F.lit(1)), ",")
    return df.withColumn("ref", F.get(parts, F.lit(0))).withColumn("alt", F.explode(alts) if every else F.get(alts, F.lit(0)))


def augmented_alleles(df: DataFrame, chunks: DataFrame, seq_len: int, chunk: int = 4096, rc: bool = True, max_shift: int = 0) -> DataFrame:
    """(id, allele_type, seq_shift, rc, seq): ``variant_alleles`` moved by up to ``max_shift`` letters to either
    side and turned round, for effects averaged over both."""
    from helixframe.operators.expand import augment

    made = augment(variant_alleles(df, chunks, seq_len + 2 * max_shift, chunk), seq_len, rc, max_shift)
    return made.select("id", "allele_type", "seq_shift", "rc", "seq")


def variant_alleles(df: DataFrame, chunks: DataFrame, seq_len: int, chunk: int = 4096) -> DataFrame:
    """(id, allele_type, seq): each variant's window with its reference and its alternative
    allele in the middle. Indels must have been filtered out."""
    windows = variants_to_intervals(df, seq_len).select("id", "chrom", "start", "end")
    seqs = intervals_to_sequences(windows, chunks, chunk)
    alleles = F.explode(F.array(F.struct(F.lit("ref").alias("allele_type"), F.col("ref").alias("allele")), F.struct(F.lit("alt").alias("allele_type"), F.col("alt").alias("allele")))).alias("x")
    both = df.select("id", "ref", "alt").join(seqs, "id").select("id", "seq", alleles)
    return both.select("id", "x.allele_type", mutate(F.col("seq"), F.col("x.allele")).alias("seq"))
