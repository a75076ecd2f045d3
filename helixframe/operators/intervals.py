"""Genomic intervals: filters, coordinate maps, range joins, merging and splitting.

Intervals are half-open and 0-based, with columns chrom, start, end, and a unique ``id`` where
an operator has to tell rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.selection import drawn_bucket, first_n, hashed_order
from helixframe.schema import INTERVALS, require_columns

#: Width of the bins that pairs of intervals meet in.
BIN = 2000
#: Widths of the levels of bins that filters by overlap meet in; the last is more than any chromosome has.
LEVELS = tuple(2048 * 8**i for i in range(8))


def filter_intervals(df: DataFrame, keep: Column) -> DataFrame:
    return df.filter(keep)


def human_chromosomes(kind: str) -> list[str]:
    extra = {"autosomes": [], "autosomesX": ["chrX"], "autosomesXY": ["chrX", "chrY"]}[kind]
    return [f"chr{i}" for i in range(1, 23)] + extra


def chromosome_set(sizes: DataFrame, kind: str = "autosomes") -> DataFrame:
    """The chromosomes of a sizes table that ``kind`` names, numbered ones by pattern."""
    extra = {"autosomes": [], "autosomesX": ["chrX"], "autosomesXY": ["chrX", "chrY"]}[kind]
    return require_columns(sizes, "chrom").filter(F.col("chrom").rlike("^chr[0-9]+$") | F.col("chrom").isin(extra)).select("chrom")


def filter_chromosomes(df: DataFrame, include: Sequence[str] | str | None = None, exclude: Sequence[str] | str | None = None) -> DataFrame:
    """Rows on an included chromosome and on no excluded one; a string names a human set."""
    require_columns(df, "chrom")
    if include is not None:
        df = df.filter(F.col("chrom").isin(human_chromosomes(include) if isinstance(include, str) else list(include)))
    if exclude is not None:
        df = df.filter(~F.col("chrom").isin(human_chromosomes(exclude) if isinstance(exclude, str) else list(exclude)))
    return df


def _with_size(df: DataFrame, sizes: DataFrame) -> DataFrame:
    # a sizes table has one row a chromosome or contig; Spark broadcasts it while it is small
    return require_columns(df, *INTERVALS).join(require_columns(sizes, "chrom", "size").select("chrom", F.col("size").alias("size__")), "chrom", "left")


def filter_chrom_ends(df: DataFrame, sizes: DataFrame, pad: int = 0) -> DataFrame:
    """Rows that keep ``pad`` from both ends; a chromosome without size has no end."""
    inside = (F.col("start") >= pad) & (F.col("size__").isNull() | (F.col("end") <= F.col("size__") - pad))
    return _with_size(df, sizes).filter(inside).select(*df.columns)


def check_chrom_ends(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows that reach over an end: what ``filter_chrom_ends`` drops."""
    outside = (F.col("start") < 0) | (F.col("size__").isNotNull() & (F.col("end") > F.col("size__")))
    return _with_size(df, sizes).filter(outside).select(*df.columns)


def resize_intervals(df: DataFrame, size: int, end: str = "both") -> DataFrame:
    """Intervals of ``size``: around the middle, or with the other end kept."""
    if end == "both":
        start = F.ceil((F.col("start") + F.col("end")) / 2 - size / 2)
    elif end == "left":
        start = F.col("end") - size
    elif end == "right":
        start = F.col("start")
    else:
        raise ValueError("end must be both, left or right")
    return require_columns(df, *INTERVALS).withColumn("start", start.cast("long")).withColumn("end", F.col("start") + size)


def unique_length(df: DataFrame) -> int:
    """The one length of all intervals; a ValueError if there are several, or none."""
    low, high = require_columns(df, *INTERVALS).agg(F.min(F.col("end") - F.col("start")), F.max(F.col("end") - F.col("start"))).first()
    if low is None or low != high:
        raise ValueError("there are no intervals" if low is None else f"lengths go from {low} to {high}")
    return low


def clip_intervals(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None:
        df = df.withColumn("start", F.greatest("start", F.lit(start)))
    return df if end is None else df.withColumn("end", F.least("end", F.lit(end)))


def extend_from_coord(df: DataFrame, size: int, center: str = "summit") -> DataFrame:
    """Intervals of ``size`` around start plus the ``center`` offset."""
    return require_columns(df, *INTERVALS, center).withColumn("start", F.col("start") + F.col(center) - size // 2).withColumn("end", F.col("start") + size)


def expand_intervals(df: DataFrame, window: int) -> DataFrame:
    return df.withColumn("start", F.col("start") - window).withColumn("end", F.col("end") + window)


def coord_to_bin(coord: Column, start_pos: Column | int = 0, bin_size: int = 1, crop_len: int = 0) -> Column:
    return F.floor((coord - start_pos) / bin_size - crop_len)


def bin_to_coord(index: Column, start_pos: int = 0, bin_size: int = 1, crop_len: int = 0, at: str = "start") -> Column:
    return (index + crop_len + (1 if at == "end" else 0)) * bin_size + start_pos


def crop_intervals(df: DataFrame, bin_size: int, crop_len: int) -> DataFrame:
    return expand_intervals(df, -crop_len * bin_size)


def intervals_to_bins(df: DataFrame, start_pos: int = 0, bin_size: int = 1, crop_len: int = 0, n_bins: int | None = None) -> DataFrame:
    """``start_bin`` and ``end_bin`` (the bin of the end, and one more), and whether either is
    out of the output's range."""
    first, last = coord_to_bin(F.col("start"), start_pos, bin_size, crop_len), coord_to_bin(F.col("end"), start_pos, bin_size, crop_len) + 1
    beyond = F.lit(False) if n_bins is None else F.col("end_bin") > n_bins
    return df.withColumn("start_bin", first).withColumn("end_bin", last).withColumn("out_of_range", (F.col("start_bin") < 0) | beyond)


def tile_positions(df: DataFrame, seq_len: Column | int, tile: int, stride: int, protect: int = 0) -> DataFrame:
    """One row a tile start that touches none of the ``protect`` central letters, and its
    distance from the start of the protected centre. ``seq_len`` may be a column; sequences shorter
    than a tile have none."""
    size = F.lit(seq_len) if isinstance(seq_len, int) else seq_len
    left = F.floor((size - protect) / 2).cast("int")
    starts = F.when(size >= tile, F.sequence(F.lit(0), F.greatest(size - tile, F.lit(0)).cast("int"), F.lit(stride)))
    free = F.filter(starts, lambda s: (s + tile <= left) | (s >= left + protect)) if protect else starts
    return df.withColumn("tile_start", F.explode(free)).withColumn("distance", F.col("tile_start") - left)


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def _binned(df: DataFrame, ref: DataFrame, window: int, width: int, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    a = require_columns(df, "id", *INTERVALS).select("id", "chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = require_columns(ref, *INTERVALS).select("chrom", (F.col("start") - window).alias("b_start"), (F.col("end") + window).alias("b_end"), *carry)
    return a.withColumn("bin", F.explode(_bins(F.col("a_start"), F.col("a_end"), width))), b.withColumn("bin", F.explode(_bins(F.col("b_start"), F.col("b_end"), width)))


def _keyed(df: DataFrame, levels: Sequence[int]) -> DataFrame:
    """``df`` with one key a row: the smallest level of bins that are no shorter than it, and the bin of its start."""
    level = sum(((F.col("end") - F.col("start") > w).cast("int") for w in levels[:-1]), F.lit(0))
    width = F.get(F.array(*[F.lit(w) for w in levels]), level)
    return df.withColumn("level__", level).withColumn("bin__", F.floor(F.col("start") / width))


def _reached(ref: DataFrame, window: int, levels: Sequence[int]) -> DataFrame:
    """The widened reference, once for each bin of each level in which an interval of that level that
    overlaps it may start: from one bin's width before it to its end."""
    low, high = F.col("start") - window, F.col("end") + window

    def bins_of(level: int, width: int) -> Column:
        reach = F.when(low - width + 1 <= high, F.sequence(F.floor((low - width + 1) / width), F.floor(high / width)))
        return F.transform(reach, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))

    bins = [bins_of(i, w) for i, w in enumerate(levels)]
    every = F.flatten(F.filter(F.array(*bins), lambda x: x.isNotNull()))
    spread = require_columns(ref, *INTERVALS).select(F.col("chrom").alias("r_chrom__"), low.alias("r_start__"), high.alias("r_end__"), F.explode(every).alias("at__"))
    return spread.select("r_chrom__", "r_start__", "r_end__", F.col("at__.level").alias("r_level__"), F.col("at__.bin").alias("r_bin__"))


def filter_overlapping(df: DataFrame, ref: DataFrame, window: int = 0, invert: bool = False, method: str = "any", levels: Sequence[int] = LEVELS) -> DataFrame:
    """Rows of ``df`` that overlap a reference interval widened by ``window`` ("any"), or that lie inside
    one ("all"); with ``invert`` the others.

    One join, in which each row of ``df`` has one key: (chrom, level, bin), the level being given by its length.
    The reference is spread over the few bins of each level that it reaches, an interval of n bases over about
    n / 1,800 + 16, so a chromosome is spread over its bins. Where the reference is small, Spark sends it to all tasks and
    ``df`` isn't shuffled. ``df`` needs no id; rows alike are judged each on its own.
    """
    a, b = _keyed(require_columns(df, *INTERVALS), levels), _reached(ref, window, levels)
    overlaps = (F.col("start") < F.col("r_end__")) & (F.col("end") > F.col("r_start__"))
    inside = (F.col("start") >= F.col("r_start__")) & (F.col("end") <= F.col("r_end__"))
    on = (F.col("chrom") == F.col("r_chrom__")) & (F.col("level__") == F.col("r_level__")) & (F.col("bin__") == F.col("r_bin__"))
    return a.join(b, on & {"any": overlaps, "all": inside}[method], "left_anti" if invert else "left_semi").select(*df.columns)


def filter_blacklist(df: DataFrame, blacklist: DataFrame, window: int = 0) -> DataFrame:
    return filter_overlapping(df, blacklist, window, invert=True)


def overlap_pairs(df: DataFrame, ref: DataFrame, width: int = BIN, carry: Sequence[str] = ()) -> DataFrame:
    """(id, chrom, a_start, a_end, b_start, b_end) and the reference's ``carry`` columns of every
    overlapping pair, once each: a pair counts in the first bin that both sides are in."""
    a, b = _binned(df, ref, 0, width, carry)
    first = F.greatest(F.floor(F.col("a_start") / width), F.floor(F.col("b_start") / width))
    return a.join(b, ["chrom", "bin"]).filter((F.col("bin") == first) & (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))).drop("bin")


def merge_intervals_by_column(df: DataFrame, group: str, count: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One interval a group, from its least start to its largest end, with its number of rows in the column ``count`` if that is
    named; and, apart from those, the groups that lie on several chromosomes or strands, which can't be merged."""
    stranded = "strand" in df.columns
    made = df.groupBy(group).agg(
        F.min("chrom").alias("chrom"), F.max("chrom").alias("chrom__"), F.min("start").alias("start"), F.max("end").alias("end"),
        *([F.min("strand").alias("strand"), F.max("strand").alias("strand__")] if stranded else []), *([F.count("*").alias(count)] if count else []),
    )
    one = F.col("chrom") == F.col("chrom__")
    if stranded:
        one = one & F.col("strand").eqNullSafe(F.col("strand__"))
    names = ["chrom", "start", "end", *(["strand"] if stranded else []), *([count] if count else []), group]
    return made.filter(one).select(*names), made.filter(~one).select(group)


def sample_n(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for any partitioning: the first by a draw for each key."""
    order = hashed_order(seed, key)
    return first_n(df, n, drawn_bucket(order), order, F.col(key))


def split(df: DataFrame, train: Sequence[str] | None = None, val: Sequence[str] = ("chr10",), test: Sequence[str] = ("chr11",), sample: dict[str, int] | None = None, key: str = "id", seed: int = 0) -> DataFrame:
    """``df`` plus ``split``: val, test or train by chromosome, the first that fits; other rows
    go to train if no training chromosomes are named, else nowhere. ``sample`` keeps so many rows
    of a split, by a seeded draw."""
    named = F.when(F.col("chrom").isin(list(val)), "val").when(F.col("chrom").isin(list(test)), "test")
    named = named.otherwise("train") if train is None else named.when(F.col("chrom").isin(list(train)), "train")
    made = df.withColumn("split", named).filter(F.col("split").isNotNull())
    if not sample:
        return made
    out = made.filter(~F.col("split").isin(list(sample)))
    for name, n in sample.items():
        out = out.unionByName(sample_n(made.filter(F.col("split") == name), n, key, seed))
    return out


def add_negatives(df: DataFrame, negatives: DataFrame, label: float = 0.0, name: str = "label") -> DataFrame:
    """Rows of both tables, the negatives with a constant label and marked by ``is_negative``."""
    both = df.withColumn("is_negative", F.lit(False)).unionByName(negatives.withColumn(name, F.lit(label)).withColumn("is_negative", F.lit(True)), allowMissingColumns=True)
    return both


def selected_bins(df: DataFrame, bin_size: int, start_pos: int = 0, crop_len: int = 0) -> DataFrame:
    """The distinct output bins that the intervals cover."""
    binned = intervals_to_bins(df, start_pos, bin_size, crop_len)
    return binned.select(F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("bin")).distinct()
