"""Motif scans, site scores and motif similarity. Motifs are rows (motif, pos, base, prob)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.metrics import running_counts
from helixframe.schema import BASES

#: Added to each probability before its logarithm, and the width of a score step for p-values.
EPS, STEP = 1e-4, 0.1


def log_odds(motifs: DataFrame) -> DataFrame:
    """(motif, pos, base, score): log2 of the probability over that of a uniform background."""
    return motifs.select("motif", "pos", "base", F.log2((F.col("prob") + EPS) * 4).alias("score"))


def consensus(motifs: DataFrame, seed: int | None = None) -> DataFrame:
    """(motif, seq): the likeliest base at each position, the first one of equals; with a seed, a base drawn
    by its probability."""
    if seed is None:
        best = motifs.groupBy("motif", "pos").agg(F.max_by("base", F.struct("prob", -F.ascii("base"))).alias("base"))
    else:
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "motif", "pos"), 11) / F.lit(float(1 << 53))
        upto = F.sum("prob").over(Window.partitionBy("motif", "pos").orderBy("base").rowsBetween(Window.unboundedPreceding, 0))
        whole = F.sum("prob").over(Window.partitionBy("motif", "pos"))
        best = motifs.withColumn("upto", upto / whole).filter(draw < F.col("upto")).groupBy("motif", "pos").agg(F.min("base").alias("base"))
    return best.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))


def trim_motif(motifs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The stretch from the first to the last position whose sum of absolute values is at least
    ``threshold`` of the largest one, numbered anew from 0."""
    sums = motifs.groupBy("motif", "pos").agg(F.sum(F.abs("prob")).alias("sum"))
    kept = sums.withColumn("top", F.max("sum").over(Window.partitionBy("motif"))).filter(F.col("sum") >= F.col("top") * threshold)
    ends = kept.groupBy("motif").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return motifs.join(ends, "motif").filter("pos BETWEEN first AND last").select("motif", (F.col("pos") - F.col("first")).alias("pos"), "base", "prob")


def _tail(scores: np.ndarray) -> tuple[int, np.ndarray]:
    """From log odds by position and base: the least sum of rounded scores, and the chances that a random
    window's is that or more, by steps; by convolution over the positions."""
    cells = np.rint(scores / STEP).astype(int)
    low, chances = 0, np.ones(1)
    for row in cells:
        grown = np.zeros(len(chances) + row.max() - row.min())
        for step in row:
            grown[step - row.min() : step - row.min() + len(chances)] += chances / 4
        low, chances = low + int(row.min()), grown
    return low, np.minimum(chances[::-1].cumsum()[::-1], 1.0)


def _odds(frame: pd.DataFrame) -> np.ndarray:
    return np.log2((frame.pivot(index="pos", columns="base", values="prob")[list(BASES)].to_numpy() + EPS) * 4)


def motif_pvalues(motifs: DataFrame) -> DataFrame:
    """(motif, step, p): the chance that a random window's sum of rounded scores is ``step`` or more."""

    def table(frame: pd.DataFrame) -> pd.DataFrame:
        low, tail = _tail(_odds(frame))
        return pd.DataFrame({"motif": frame["motif"].iloc[0], "step": np.arange(low, low + len(tail)), "p": tail})

    return motifs.groupBy("motif").applyInPandas(table, "motif string, step long, p double")


def _matrices(motifs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """The motif table as matrices. It is a catalogue of at most some thousand motifs of a
    few dozen rows, which each task needs whole; more than a million rows are refused."""
    rows = motifs.limit(1_000_001).toPandas()
    if len(rows) > 1_000_000:
        raise ValueError("a motif catalogue has at most a million rows")
    held = [(name, _odds(own)) for name, own in rows.groupby("motif", sort=True)]
    return [n for n, _ in held], [m for _, m in held]


#: Letters that are scanned at a time.
SLICE = 1 << 20


def scan_motifs(seqs: DataFrame, motifs: DataFrame, p_below: float = 1e-3, rc: bool = True) -> DataFrame:
    """(id, motif, start, end, strand, score, p_value, matched_seq): windows whose p-value is below
    ``p_below``. A letter other than A, C, G and T adds 0. Coordinates and text are forward.

    The sequences of a batch are laid end to end, parted by a letter that no window survives, so
    that each motif is one pass over long arrays."""
    names, scores = _matrices(motifs)
    code = np.full(256, 4, "uint8")
    code[[ord(b) for b in BASES]] = range(4)
    apart = 5
    sides = []
    for name, own in zip(names, scores):
        low, tail = _tail(own)
        for strand in ("+", "-") if rc else ("+",):
            turned = own if strand == "+" else own[::-1, ::-1]
            sides.append((name, strand, np.vstack([turned.T, np.zeros(len(own)), np.full(len(own), -np.inf)]), low, np.append(tail, 0.0)))
    columns = ["id", "motif", "start", "end", "strand", "score", "p_value", "matched_seq"]

    def hits(keys: list, texts: list[str]) -> pd.DataFrame:
        parts = [code[np.frombuffer(t.encode("ascii", "replace"), "uint8")] for t in texts]
        lengths = np.array([len(x) + 1 for x in parts])
        flat = np.concatenate([y for x in parts for y in (x, [apart])]).astype("uint8")
        begins = np.append(0, lengths.cumsum()[:-1])
        out = []
        for name, strand, weights, low, tail in sides:
            width = weights.shape[1]
            if len(flat) < width:
                continue
            sums = sum(weights[flat[i : len(flat) - width + 1 + i], i] for i in range(width))
            steps = np.full(len(sums), len(tail) - 1)
            whole = np.isfinite(sums)
            steps[whole] = np.clip(np.trunc(sums[whole] / STEP).astype(int) - low, 0, len(tail) - 1)
            at = np.flatnonzero(whole & (tail[steps] < p_below))
            row = np.searchsorted(begins, at, "right") - 1
            start = at - begins[row]
            out.append(pd.DataFrame({"id": [keys[r] for r in row], "motif": name, "start": start, "end": start + width, "strand": strand, "score": sums[at], "p_value": tail[steps[at]], "matched_seq": [texts[r][a : a + width] for r, a in zip(row.tolist(), start.tolist())]}, columns=columns))
        return pd.concat(out) if out else pd.DataFrame([], columns=columns)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, texts, letters = [], [], 0
            for key, seq in zip(frame["id"], frame["seq"]):
                keys.append(key)
                texts.append(seq or "")
                letters += len(texts[-1])
                if letters >= SLICE:
                    yield hits(keys, texts)
                    keys, texts, letters = [], [], 0
            if keys:
                yield hits(keys, texts)

    return seqs.select("id", "seq").mapInPandas(scan, "id long, motif string, start long, end long, strand string, score double, p_value double, matched_seq string")


def _stranded(motifs: DataFrame, rc: bool) -> DataFrame:
    """Log odds by strand, with the matrix turned round for the reverse one."""
    odds = log_odds(motifs)
    width = Window.partitionBy("motif")
    forward = odds.withColumn("width", F.max("pos").over(width) + 1).withColumn("strand", F.lit("+"))
    if not rc:
        return forward
    turned = forward.withColumn("pos", F.col("width") - 1 - F.col("pos")).withColumn("base", F.translate("base", "ACGT", "TGCA")).withColumn("strand", F.lit("-"))
    return forward.unionByName(turned)


def score_windows(windows: DataFrame, motifs: DataFrame) -> DataFrame:
    """``windows`` (id, seq, motif, start, strand, …) plus ``score``: the motif's log odds there."""
    odds = _stranded(motifs, True).groupBy("motif", "strand").agg(F.array_sort(F.collect_list(F.struct("pos", "base", "score"))).alias("odds__"))
    there = lambda x: F.when(F.substring(F.col("seq"), (F.col("start") + x["pos"] + 1).cast("int"), F.lit(1)) == x["base"], x["score"]).otherwise(0.0)
    total = F.aggregate("odds__", F.lit(0.0), lambda sum, x: sum + there(x))
    # a catalogue (see _matrices): one row a motif and strand
    return windows.join(F.broadcast(odds), ["motif", "strand"]).select(*windows.columns, total.alias("score"))


def with_pvalues(scored: DataFrame, motifs: DataFrame, score: str = "score", out: str = "p_value") -> DataFrame:
    step = F.expr(f"cast({score} / {STEP} as long)")
    table = motif_pvalues(motifs).select("motif", F.col("step").alias("step__"), F.col("p").alias(out))
    # a table of the catalogue, and its keys are few: by a shuffle many rows would meet under one
    return scored.withColumn("step__", step).join(F.broadcast(table), ["motif", "step__"], "left").drop("step__").withColumn(out, F.coalesce(out, F.lit(0.0)))


def site_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("id", "motif").agg(F.count("*").alias("n_sites"))


def motif_score(seqs: DataFrame, sites: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(id, motif_score): each sequence's sites, weighted by (motif, weight); 0 without any."""
    counts = site_counts(sites)
    value = F.col("n_sites").cast("double")
    if weights is not None:
        counts, value = counts.join(weights, "motif"), F.col("n_sites") * F.col("weight")
    sums = counts.groupBy("id").agg(F.sum(value).alias("motif_score"))
    return seqs.select("id").join(sums, "id", "left").select("id", F.coalesce("motif_score", F.lit(0.0)).alias("motif_score"))


def score_sites(sites: DataFrame, attributions: DataFrame) -> DataFrame:
    """``sites`` plus ``site_attr_score``: the mean attribution over all four bases of each site.
    ``attributions`` is (id, pos, base, value)."""
    keys = ["id", "motif", "start", "end", "strand"]
    spread = sites.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    means = spread.join(attributions, ["id", "pos"]).groupBy(*keys).agg((F.sum("value") / (4 * (F.first("end") - F.first("start")))).alias("site_attr_score"))
    return sites.join(means, keys, "left")


def score_motif_match(sites: DataFrame, attributions: DataFrame, motifs: DataFrame) -> DataFrame:
    """``sites`` plus ``motif_attr_score``: mean over positions of attribution times probability,
    the motif turned round on strand "-"."""
    keys = ["id", "motif", "start", "end", "strand"]
    last = F.col("end") - 1
    spread = sites.select(*keys, F.explode(F.sequence("start", last)).alias("pos"))
    met = spread.join(attributions, ["id", "pos"])
    offset = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    read = F.when(F.col("strand") == "-", F.translate("base", "ACGT", "TGCA")).otherwise(F.col("base"))
    own = motifs.select("motif", F.col("pos").cast("long").alias("offset"), F.col("base").alias("read"), "prob")
    made = met.withColumn("offset", offset).withColumn("read", read).join(own, ["motif", "offset", "read"])
    sums = made.groupBy(*keys).agg((F.sum(F.col("value") * F.col("prob")) / (F.first("end") - F.first("start"))).alias("motif_attr_score"))
    return sites.join(sums, keys, "left")


def compare_motifs(pairs: DataFrame, motifs: DataFrame, p_below: float = 1e-3, rc: bool = True) -> DataFrame:
    """(id, motif, start, end, strand, score_ref, score_alt, p_ref, p_alt, score_diff) of every window
    that is a hit in the reference or the alternative sequence and whose score differs.
    ``pairs`` is (id, ref_seq, alt_seq); both sides of a window are scored, hit or not."""
    keys = ["id", "motif", "start", "end", "strand"]
    hits = None
    for side in ("ref_seq", "alt_seq"):
        own = scan_motifs(pairs.select("id", F.col(side).alias("seq")), motifs, p_below, rc).select(*keys)
        hits = own if hits is None else hits.unionByName(own)
    windows = hits.distinct().join(pairs, "id")
    out = windows
    for side in ("ref", "alt"):
        scored = score_windows(out.withColumn("seq", F.col(f"{side}_seq")), motifs).withColumnRenamed("score", f"score_{side}").drop("seq")
        out = with_pvalues(scored, motifs, f"score_{side}", f"p_{side}")
    out = out.select(*keys, "score_ref", "p_ref", "score_alt", "p_alt")
    return out.filter(F.abs(F.col("score_ref") - F.col("score_alt")) > 1e-9).withColumn("score_diff", F.col("score_alt") - F.col("score_ref"))


def by_difference(compared: DataFrame) -> DataFrame:
    """Compared hits in ascending order of their score difference (then by their keys)."""
    return compared.orderBy("score_diff", "id", "motif", "start", "strand")


def fdr_bh(df: DataFrame, p: str, by: str, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values of ``p`` within each ``by``; null for a null p, which counts as no test.

    Ranks are counts of the distinct p-values up to each, and the running minimum from above is
    taken within ranges of p first (finer for small ones), then over the ranges' minima: no group is
    sorted in one task.
    """
    place = lambda c: F.when(c >= 1e-3, F.floor(c * 1000)).when(c > 0, F.ceil(F.log2(c) * 16)).otherwise(-100_000).cast("long")
    points = running_counts(df.select(by, p), by, p, {"n": F.count("*")}, at=place(F.col(p)))
    raw = F.col(p) * F.col("n_all") / (F.col("n_before") + F.col("n"))
    points = points.select(by, p, place(F.col(p)).alias("range__"), raw.alias("raw"))
    least = points.groupBy(by, "range__").agg(F.min("raw").alias("raw"))
    above = least.select(by, "range__", F.min("raw").over(Window.partitionBy(by).orderBy(F.desc("range__")).rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    inner = points.withColumn("raw", F.min("raw").over(Window.partitionBy(by, "range__").orderBy(F.desc(p))))
    q = inner.join(above, [by, "range__"]).select(by, p, F.least("raw", "above", F.lit(1.0)).alias(out))
    return df.join(q, [by, p], "left").select(*df.columns, out)


def top_matches(matches: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` targets of each query with the smallest q-values (then p-values), and their place."""
    order = Window.partitionBy("query").orderBy("q_value", "p_value", "target")
    return matches.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


#: Step to which column distances are rounded.
DISTANCE_STEP = 0.01


def _alignment_chances(laid: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """``laid`` (one query's alignments: first, last, steps) plus ``p_one``: the chance that as many columns, drawn
    at random for the same stretch of the query, lie as near. The sums' distribution is the convolution of the
    distances that each of the query's columns has to all target columns (``seen``: pos, step, n)."""
    width = int(seen["pos"].max()) + 1
    one = np.zeros((width, int(seen["step"].max()) + 1))
    np.add.at(one, (seen["pos"].to_numpy(), seen["step"].to_numpy()), seen["n"].to_numpy("float64"))
    one /= one.sum(1, keepdims=True)
    chance = np.ones(len(laid))
    first, last, steps = (laid[c].to_numpy() for c in ("first", "last", "steps"))
    for begin in range(width):
        sums = np.ones(1)
        for end in range(begin + 1, width + 1):
            sums = np.convolve(sums, one[end - 1])
            own = (first == begin) & (last == end)
            if own.any():
                below = np.minimum(sums.cumsum(), 1.0)
                chance[own] = below[np.minimum(steps[own], len(below) - 1)]
    return laid.assign(p_one=chance)[["query", "target", "offset", "strand", "overlap", "distance", "p_one"]]


def motif_similarity(queries: DataFrame, targets: DataFrame, min_overlap: int = 1) -> DataFrame:
    """(query, target, offset, strand, overlap, distance, p_value, e_value, q_value, query_consensus, target_consensus).

    Every query is laid over every target at each offset and both strands. An alignment's score is the sum of the
    Euclidean distances of the columns laid over each other, in steps of 0.01; its p-value is exact for the null that a
    column's partner is drawn from all columns of all targets (see ``_alignment_chances``). The alignment with the
    smallest p-value is kept (of equals the one with more overlap, on strand "+", with the smaller offset); as the least of
    as many as were tried it has p = 1 - (1 - p_one) ** tried. ``distance`` is the mean over the columns laid over each
    other. The product of the two catalogues is the work asked for; each of its pairs has bounded offsets, and a
    query's alignments are put together in one task: those with a catalogue of targets.
    """
    width = lambda df, name: df.groupBy(name).agg((F.max("pos") + 1).alias(f"{name}_width"))
    q = queries.select(F.col("motif").alias("query"), "pos", "base", "prob")
    t = targets.select(F.col("motif").alias("target"), "pos", "base", "prob")
    q_width, t_width = width(q, "query"), width(t, "target")
    both = t.withColumn("strand", F.lit("+"))
    turned = t.join(t_width, "target").select("target", (F.col("target_width") - 1 - F.col("pos")).alias("pos"), F.translate("base", "ACGT", "TGCA").alias("base"), "prob").withColumn("strand", F.lit("-"))
    both = both.unionByName(turned)
    laid = q_width.crossJoin(t_width).withColumn("offset", F.explode(F.sequence(1 - F.col("query_width"), F.col("target_width") - 1)))
    cells = laid.join(q, "query").withColumn("at", F.col("pos") + F.col("offset")).join(both.select("target", F.col("pos").alias("at"), "base", F.col("prob").alias("prob_t"), "strand"), ["target", "at", "base"])
    columns = cells.groupBy("query", "target", "offset", "strand", "pos").agg(F.sqrt(F.sum(F.pow(F.col("prob") - F.col("prob_t"), 2))).alias("apart"))
    columns = columns.withColumn("step", F.round(F.col("apart") / DISTANCE_STEP).cast("long"))
    # over all offsets each column of the query meets each column of the targets once a strand
    seen = columns.groupBy("query", F.col("pos").cast("long").alias("pos"), "step").agg(F.count("*").alias("n")).toDF("query", "pos", "step", "n")
    own = columns.groupBy("query", "target", "offset", "strand").agg(F.min("pos").cast("long").alias("first"), (F.max("pos") + 1).cast("long").alias("last"), F.sum("step").alias("steps"), F.count("*").alias("overlap"), F.avg("apart").alias("distance"))
    own = own.filter(F.col("overlap") >= min_overlap).withColumn("offset", F.col("offset").cast("long"))
    own = own.toDF(*own.columns)  # names of its own beside those of ``seen``
    chances = own.groupBy("query").cogroup(seen.groupBy("query")).applyInPandas(lambda a, b: _alignment_chances(a, b) if len(a) else pd.DataFrame({"query": [], "target": [], "offset": [], "strand": [], "overlap": [], "distance": [], "p_one": []}), "query string, target string, offset long, strand string, overlap long, distance double, p_one double")
    order = F.struct(F.round("p_one", 12), -F.col("overlap"), F.col("strand"), F.col("offset"))
    best = chances.groupBy("query", "target").agg(F.count("*").alias("tried"), F.min_by(F.struct("offset", "strand", "overlap", "distance", "p_one"), order).alias("best")).select("query", "target", "tried", "best.*")
    counted = best.withColumn("n", F.count("*").over(Window.partitionBy("query")))
    ranked = counted.withColumn("p_value", -F.expm1(F.col("tried") * F.log1p(-F.least("p_one", F.lit(1 - 1e-15))))).withColumn("e_value", F.col("p_value") * F.col("n"))
    named = ranked.join(consensus(queries).toDF("query", "query_consensus"), "query").join(consensus(targets).toDF("target", "target_consensus"), "target")
    return fdr_bh(named, "p_value", "query").select("query", "target", "offset", "strand", "overlap", "distance", "p_value", "e_value", "q_value", "query_consensus", "target_consensus")


def significant(df: DataFrame, column: str, most: float) -> DataFrame:
    return df.filter(F.col(column) <= most)


def name_subset(motifs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The named motifs, and the names that there is no motif for."""
    return motifs.join(names, "motif", "left_semi"), names.join(motifs.select("motif"), "motif", "left_anti")
