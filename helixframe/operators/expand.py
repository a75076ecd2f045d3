"""One sequence to many: augmentation, mutants, inserted patterns, shuffled backgrounds.

The product of axes is rows with key columns. It is made by ``explode`` within a stage and is meant
to be scored and aggregated there. Random operators draw by (seed, key), so that results are the
same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from helixframe.functions.sequence import gc_fraction, mutate, reverse_complement
from helixframe.operators.genome import interval_counts, tiled_counts
from helixframe.operators.intervals import filter_chromosomes, filter_overlapping, tile_positions
from helixframe.operators.selection import drawn_bucket, first_n, hashed_order
from helixframe.schema import BASES, INTERVALS, require_columns
from helixframe.scratch import cut


def random_sequences(spark, seq_len: int, n: int, seed: int = 0) -> DataFrame:
    """(id, seq): ``n`` random strings over ACGT, fixed by the seed."""
    letter = lambda i: F.substring(F.lit(BASES), (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(4)) + 1).cast("int"), F.lit(1))
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(seq_len)), letter), "").alias("seq"))


def augment(df: DataFrame, seq_len: Column | int, rc: bool = False, max_seq_shift: int = 0, max_pair_shift: int = 0, one: bool = False, seed: int = 0) -> DataFrame:
    """Rows of ``df`` (id, seq of length seq_len, which may be a column, + 2 * both shifts) times (pair_shift, seq_shift, rc):
    the window at the sum of the shifts, reverse-complemented or not. With ``one``, one of
    them a row, drawn by the seed."""
    axes = F.array(*[F.struct(F.lit(p).alias("pair_shift"), F.lit(s).alias("seq_shift"), F.lit(r).alias("rc")) for r in ((False, True) if rc else (False,)) for s in range(2 * max_seq_shift + 1) for p in range(2 * max_pair_shift + 1)])
    n = (1 + rc) * (2 * max_seq_shift + 1) * (2 * max_pair_shift + 1)
    chosen = F.array(F.get(axes, F.pmod(hashed_order(seed, "id"), F.lit(n)).cast("int"))) if one else axes
    made = df.withColumn("axis__", F.explode(chosen)).select("*", "axis__.*").drop("axis__")
    window = F.substring("seq", F.col("seq_shift") + F.col("pair_shift") + 1, F.lit(seq_len) if isinstance(seq_len, int) else seq_len)
    return made.withColumn("seq", F.when(F.col("rc"), reverse_complement(window)).otherwise(window))


def saturation_mutants(df: DataFrame, positions: Sequence[int] | None = None, drop_ref: bool = False) -> DataFrame:
    """(…, pos, base, seq): every base at every position; without the one there if asked."""
    # from the end on, what follows a place stood in the rows just before: written files are smaller than the other way round
    places = F.sequence(F.length("seq") - 1, F.lit(0)) if positions is None else F.array(*map(F.lit, positions))
    # what stands on both sides of a place is cut once for all its bases
    made = df.withColumn("pos", F.explode(places)).withColumns({"left__": F.substring(F.col("seq"), F.lit(1), F.col("pos")), "was__": F.substring("seq", F.col("pos") + 1, F.lit(1)), "right__": F.substring(F.col("seq"), F.col("pos") + 2, F.length("seq"))})
    made = made.withColumn("base", F.explode(F.array(*map(F.lit, BASES))))
    if drop_ref:
        made = made.filter("base <> was__")
    return made.withColumn("seq", F.concat("left__", "base", "right__")).drop("left__", "was__", "right__")


def first_mutants(df: DataFrame) -> DataFrame:
    """(…, pos, base, seq): of the substitutions of one letter by another, which all give the same counts of letters,
    the first; for each letter of a sequence and each other base."""
    firsts = F.transform(F.array_distinct(F.split("seq", "")), lambda x: F.instr(F.col("seq"), x) - 1)
    made = df.filter(F.length("seq") > 0).withColumn("pos", F.explode(firsts)).withColumn("base", F.explode(F.array(*map(F.lit, BASES))))
    made = made.filter(F.col("base") != F.substring("seq", F.col("pos") + 1, F.lit(1)))
    return made.withColumn("seq", mutate(F.col("seq"), F.col("base"), F.col("pos")))


def pattern_scan(df: DataFrame, patterns: Sequence[str], positions: Sequence[int] | None = None) -> DataFrame:
    """(…, pos, pattern, seq): each pattern written at each position that fits the longest one."""
    longest = max(map(len, patterns))
    places = F.sequence(F.lit(0), F.length("seq") - longest) if positions is None else F.array(*map(F.lit, positions))
    made = df.filter(F.length("seq") >= longest).withColumn("pos", F.explode(places)).withColumn("pattern", F.explode(F.array(*map(F.lit, patterns))))
    return made.withColumn("seq", mutate(F.col("seq"), F.col("pattern"), F.col("pos")))


#: Letters that are shuffled at a time, and rows, whose numbers take 16 bits of a sorted key.
SLICE, SLICE_ROWS = 1 << 18, 1 << 16
#: Rows from which on their walks go on side by side; fewer are walked one by one.
WALKS = 16


def _scrambled(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of ``x`` (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _walks(letters: np.ndarray, lengths: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The letters (codes from 0, sequence after sequence, each of three at least) walked anew: a random walk over all of a
    sequence's steps that starts and ends where it does.

    Each letter's steps are put in the order of their drawn numbers. Where every letter's last step leads on to
    the sequence's end, these orders are such a walk, and all walks have the same chance; otherwise the sequence draws again.
    """
    n, kinds = len(lengths), int(letters.max()) + 1
    begin = np.append(0, lengths.cumsum()[:-1])
    first, end = letters[begin], letters[begin + lengths - 1]
    # all pairs of neighbours but those of two sequences
    inside = np.ones(len(letters), bool)
    inside[begin + lengths - 1] = False
    at = np.flatnonzero(inside)
    row = np.repeat(np.arange(n), lengths - 1)
    place = (at - begin[row]).astype("uint64")
    source, target = letters[at], letters[at + 1]
    begin = np.append(0, (lengths - 1).cumsum()[:-1])
    group = row * kinds + source
    starts = np.append(0, np.bincount(group, minlength=n * kinds).cumsum())
    steps = np.empty(len(at), "int64")
    todo, own, turn = np.arange(n), np.arange(len(at)), 0
    while len(todo):
        number = _scrambled(_scrambled(draws + np.uint64(turn * 0xD1342543DE82EF95 % 2**64))[row[own]] + place[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        if kinds <= 256:
            # sequence, letter, number and target in one key: a plain sort
            key = (row[own].astype("uint64") << np.uint64(48)) | (source[own].astype("uint64") << np.uint64(40)) | (number << np.uint64(8)) | target[own].astype("uint64")
            key.sort()
            steps[own] = (key & np.uint64(255)).astype("int64")
        else:
            steps[own] = target[own][np.lexsort((target[own], number, source[own], row[own]))]
        # where the last steps lead; the end, and letters without a step, to the end
        last = np.repeat(end[todo], kinds).reshape(-1, kinds)
        upto = starts[todo[:, None] * kinds + np.arange(kinds) + 1]
        some = upto > starts[todo[:, None] * kinds + np.arange(kinds)]
        last[some] = steps[upto[some] - 1]
        last[np.arange(len(todo)), end[todo]] = end[todo]
        for _ in range(max(1, (kinds - 1).bit_length())):
            last = np.take_along_axis(last, last, 1)
        again = np.zeros(n, bool)
        again[todo] = (last != end[todo][:, None]).any(1)
        todo, own, turn = todo[again[todo]], own[again[row[own]]], turn + 1
    # the longest first, so that those still under way stand at the front
    order = np.argsort(-lengths, kind="stable")
    going = np.searchsorted(-lengths[order], -np.arange(lengths.max() + 1), "left")
    out = np.empty(len(letters), letters.dtype)
    ahead = starts[:-1].copy()
    base = order * kinds
    now, to = first[order], np.append(0, lengths.cumsum()[:-1])[order]
    out[to] = now
    for t in range(1, int(lengths.max())):
        k = going[t]
        if k < WALKS:
            break
        cell = base[:k] + now[:k]
        now = steps[ahead[cell]]
        ahead[cell] += 1
        out[to[:k] + t] = now
    else:
        return out
    for i in range(k):
        left = ahead[base[i] : base[i] + kinds].tolist()
        own, low, letter = steps[begin[order[i]] : begin[order[i]] + lengths[order[i]] - 1].tolist(), int(begin[order[i]]), int(now[i])
        made = []
        for _ in range(t, int(lengths[order[i]])):
            j = left[letter]
            left[letter] = j + 1
            letter = own[j - low]
            made.append(letter)
        out[to[i] + t : to[i] + lengths[order[i]]] = made
    return out


def _shuffled(texts: list[str], draws: np.ndarray) -> list[str]:
    """Random strings with the dinucleotides and both ends of ``texts``, all of one or more letters, each by its own draw."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "uint32")
    known = np.flatnonzero(np.bincount(points))
    code = np.zeros(int(known[-1]) + 1, "int64")
    code[known] = np.arange(len(known))
    lengths = np.array([len(t) for t in texts])
    long = lengths > 2
    made = points.copy()
    if long.any():
        held = np.repeat(long, lengths)
        made[held] = known[_walks(code[points[held]], lengths[long], draws[long])]
    whole = made.tobytes().decode("utf-32-le")
    upto = lengths.cumsum().tolist()
    return [whole[a:b] for a, b in zip([0, *upto], upto)]


def dinuc_shuffle(df: DataFrame, n: int = 1, seed: int = 0, key: str = "id", seq: str = "seq") -> DataFrame:
    """Rows of ``df`` times ``shuffle`` 0..n-1, ``seq`` shuffled with its dinucleotide counts and
    both ends kept. Sequences keep their place; the draw depends on (seed, key, shuffle). The sequences of a
    batch are walked side by side."""
    made = df.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("draw__", F.xxhash64(F.lit(seed), F.col(key), F.col("shuffle")))

    @F.pandas_udf("string")
    def shuffled(texts: pd.Series, draws: pd.Series) -> pd.Series:
        out, drawn = texts.to_numpy("object").copy(), draws.to_numpy("int64").view("uint64")
        rows, letters = [], 0
        for i, text in enumerate(out):
            if text:
                rows.append(i)
                letters += len(text)
            if rows and (letters >= SLICE or len(rows) == SLICE_ROWS or i == len(out) - 1):
                out[rows] = _shuffled([out[r] for r in rows], drawn[rows])
                rows, letters = [], 0
        return pd.Series(out, dtype="object")

    return made.withColumn(seq, shuffled(F.col(seq), F.col("draw__"))).drop("draw__")


def _backgrounds(df: DataFrame, n_shuffles: int, seed: int) -> DataFrame:
    return dinuc_shuffle(df, n_shuffles, seed) if n_shuffles else df.withColumn("shuffle", F.lit(0))


def pattern_backgrounds(df: DataFrame, patterns: Sequence[str], n_shuffles: int = 1, seed: int = 0) -> DataFrame:
    """(…, shuffle, pattern, seq): backgrounds as they are (pattern null) and with each pattern in
    the middle. No shuffles: the sequences themselves are the background."""
    made = _backgrounds(df, n_shuffles, seed).withColumn("pattern", F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, patterns))))
    return made.withColumn("seq", F.when(F.col("pattern").isNull(), F.col("seq")).otherwise(mutate(F.col("seq"), F.col("pattern"))))


def variant_backgrounds(windows: DataFrame, n_shuffles: int = 100, seed: int = 0) -> DataFrame:
    """(id, shuffle, allele_type, seq) from (id, ref, alt, seq): shuffled windows with each allele."""
    made = _backgrounds(windows, n_shuffles, seed)
    both = made.withColumn("x", F.explode(F.array(F.struct(F.lit("ref").alias("allele_type"), F.col("ref").alias("allele")), F.struct(F.lit("alt").alias("allele_type"), F.col("alt").alias("allele")))))
    return both.select("id", "shuffle", "x.allele_type", mutate(F.col("seq"), F.col("x.allele")).alias("seq"))


def pattern_spacing(df: DataFrame, fixed: str, moving: str, seq_len: Column | int, stride: int = 1, n_shuffles: int = 1, seed: int = 0, own: str | None = None) -> DataFrame:
    """(…, shuffle, tile_start, distance, seq): ``fixed`` in the middle, and ``moving`` at every tiled
    place beside it or (tile_start null) nowhere. With ``own`` the sequence that has ``moving`` nowhere is not
    a row of its own but a column of that name in each row."""
    made = _backgrounds(df, n_shuffles, seed).withColumn("seq", mutate(F.col("seq"), F.lit(fixed)))
    if own:
        made = made.withColumn(own, F.col("seq"))
    placed = tile_positions(made, seq_len, len(moving), stride, len(fixed)).withColumn("seq", mutate(F.col("seq"), F.lit(moving), F.col("tile_start")))
    if own:
        return placed
    alone = made.withColumn("tile_start", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("int"))
    return placed.unionByName(alone)


def tile_shuffles(df: DataFrame, tile: int, seq_len: Column | int, stride: int | None = None, protect: int = 0, n_shuffles: int = 1, seed: int = 0) -> DataFrame:
    """(…, tile_start, shuffle, seq): only the tile's letters shuffled."""
    tiles = tile_positions(df, seq_len, tile, stride or tile, protect).withColumn("key__", F.xxhash64("id", "tile_start"))
    made = dinuc_shuffle(tiles.withColumn("part__", F.substring("seq", F.col("tile_start") + 1, F.lit(tile))), n_shuffles, seed, "key__", "part__")
    return made.withColumn("seq", mutate(F.col("seq"), F.col("part__"), F.col("tile_start"))).drop("key__", "part__")


def random_mutants(df: DataFrame, seed: int = 0, drop_ref: bool = True, protect: Sequence[int] = ()) -> DataFrame:
    """One substitution a row, at a drawn position that is not protected."""
    places = F.filter(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: ~i.isin(list(protect)) if protect else F.lit(True))
    made = df.withColumn("places__", places).withColumn("pos", F.get("places__", F.pmod(hashed_order(seed, "id"), F.size("places__")).cast("int")))
    others = F.filter(F.array(*map(F.lit, BASES)), lambda b: b != F.substring(F.col("seq"), F.col("pos") + 1, F.lit(1)) if drop_ref else F.lit(True))
    made = made.withColumn("others__", others).withColumn("base", F.get("others__", F.pmod(hashed_order(seed + 1, "id"), F.size("others__")).cast("int")))
    return made.withColumn("seq", mutate(F.col("seq"), F.col("base"), F.col("pos"))).drop("places__", "others__")


def gc_bin(seq: Column, binwidth: float) -> Column:
    return share_bin(gc_fraction(seq), binwidth)


def share_bin(gc: Column, binwidth: float) -> Column:
    """Index of the last edge i * binwidth that a GC fraction reaches."""
    edges = F.array(*[F.lit(i * binwidth) for i in range(int(np.ceil(1 / binwidth - 1e-9)))])
    return F.size(F.filter(edges, lambda e: e <= gc)) - 1


def _matched(inputs: DataFrame, windows: DataFrame, seed: int, blacklist: DataFrame | None, *key: str) -> DataFrame:
    """Of ``windows`` that overlap no input and no blacklisted interval, as many of each ``bin`` as inputs has, or all:
    the first by a draw for each ``key``. Only a small part of a bin is ranked (``first_n``)."""
    want = inputs.groupBy("bin").agg(F.count("*").alias("want"))
    free = filter_overlapping(windows, inputs, invert=True)
    if blacklist is not None:
        free = filter_overlapping(free, blacklist, invert=True)
    order = hashed_order(seed, *key)
    # a row for each bin of the GC fraction, 1 / binwidth at most; written once, since the first n are found in several passes
    wanted = cut(free.join(F.broadcast(want), "bin").withColumn("draw__", order))
    return first_n(wanted, F.col("want"), drawn_bucket(F.col("draw__")), F.col("draw__"), *map(F.col, key), by="bin").select(*windows.columns)


def gc_matched_negatives(inputs: DataFrame, windows: DataFrame, binwidth: float = 0.1, seed: int = 0, blacklist: DataFrame | None = None) -> DataFrame:
    """As many of ``windows`` (id, chrom, start, end, seq) as ``inputs`` (the same columns) has in each
    GC bin, none overlapping an input or the blacklist: a seeded draw within each bin."""
    require_columns(windows, "id", "seq", *INTERVALS)
    bin_of = gc_bin(F.col("seq"), binwidth).alias("bin")
    return _matched(inputs.select("*", bin_of), windows.select("*", bin_of), seed, blacklist, "id")


def genome_negatives(inputs: DataFrame, chunks: DataFrame, size: int, binwidth: float = 0.1, seed: int = 0, blacklist: DataFrame | None = None, chroms: Sequence[str] | str | None = None, chunk: int = 4096) -> DataFrame:
    """(chrom, start, end, n_gc, bin): windows of ``size`` letters from the whole genome, as many of each GC bin as
    ``inputs`` (id, chrom, start, end; all of that length, see ``unique_length``) has, or all there are.

    Candidates are the windows that stand side by side on each chromosome of ``chroms`` (names, or a human set's
    name; all by default), less those that overlap an input or the blacklist. Their letters are counted in
    chunks, never put together. Inputs that reach over the genome's end are not counted.
    """
    share = share_bin(F.col("n_gc") / F.lit(float(size)), binwidth).alias("bin")
    counted = interval_counts(inputs, chunks, chunk).filter(F.col("n") == size)
    binned = inputs.join(counted.select("id", share), "id").select("id", *INTERVALS, "bin")
    tiles = tiled_counts(chunks if chroms is None else filter_chromosomes(chunks, chroms), size, chunk)
    return _matched(binned, tiles.select("*", share), seed, blacklist, "chrom", "start")
