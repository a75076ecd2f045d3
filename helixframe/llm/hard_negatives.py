"""Hard negatives by rotated one-bit codes (operator 11).

Vectors of integers are rotated once, by a fixed random rotation, and coded by signs: each code is the sign
of what the codes before it leave over, and with it the vector's alignment to the code is kept, that
is how much of the code the vector holds. So a vector is a sum of aligned codes and a residual whose length is kept.

A query is rotated likewise and rounded to eight bit planes, so its product with a code is a sum of
popcounts. The products weighted by alignments are the estimate; by Cauchy-Schwarz the true score differs by
at most |query| * |residual|, and |rounding error| * |vector|. That interval is certain, not probable:

* positives: rows whose upper end is below the fifth largest lower end are dropped;
* negatives: rows whose interval misses the band are dropped, and so are those whose upper end is below the
  tenth largest lower end of rows that are in the band for certain.

All others are scored by integers. Anchors meet all rows in pairs of blocks of bounded size; each pair of
blocks hands on the best of its rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch

#: Codes of a vector, and bit planes of a rounded query.
LEVELS, PLANES = 6, 8
#: Rows and anchors of a block at most, on the average.
ROWS, ANCHORS = 8192, 2048
#: Blocks of rows for each partition of a shuffle, at least.
SPREAD = 4
#: Components beyond this are clipped, so that scores of 1,000 components fit 64 bits.
MOST = 1 << 26
#: Pairs whose estimates are held at a time.
PAIRS = 1 << 17
#: Share of all lengths' product that stands for rounding of floating-point sums.
SLACK = 1e-9


@lru_cache(maxsize=4)
def _rotation(n: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(20_011).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def encode(x: np.ndarray) -> dict[str, np.ndarray]:
    """codes (n, LEVELS, words), alignment (n, LEVELS), rest (the residual's length) and norm of the rows
    of integers x; their number of components is a multiple of 64."""
    left = x.astype("float64") @ _rotation(x.shape[1])
    norm, codes, alignment = np.linalg.norm(x.astype("float64"), axis=1), [], []
    for _ in range(LEVELS):
        codes.append(_packed(left >= 0))
        alignment.append(np.abs(left).mean(1))
        left -= np.where(left >= 0, 1.0, -1.0) * alignment[-1][:, None]
    return {"codes": np.stack(codes, 1), "alignment": np.stack(alignment, 1), "rest": np.linalg.norm(left, axis=1), "norm": norm}


class Queries:
    """Rotated queries as bit planes."""

    def __init__(self, q: np.ndarray):
        turned = q.astype("float64") @ _rotation(q.shape[1])
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - low) / step)
        rounded = low + step * level
        self.low, self.step = low[:, 0], step[:, 0]
        self.planes = np.stack([_packed(level.astype("int64") >> p & 1 == 1) for p in range(PLANES)], 1)
        self.sum = level.sum(1)
        self.length, self.error = np.linalg.norm(rounded, axis=1), np.linalg.norm(turned - rounded, axis=1)
        self.components = q.shape[1]

    def intervals(self, at: slice, codes: np.ndarray, alignment: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the intervals of the scores of some queries (rows) with coded vectors (columns)."""
        planes, low, step = self.planes[at], self.low[at, None], self.step[at, None]
        estimate = np.zeros((len(planes), len(codes)))
        for k in range(LEVELS):
            ones = np.bitwise_count(codes[:, k]).sum(1, dtype="int64")
            met = np.zeros((len(planes), len(codes)), "int64")
            for p in range(PLANES):
                for word in range(codes.shape[2]):
                    met += np.bitwise_count(planes[:, p, word, None] & codes[None, :, k, word]).astype("int64") << p
            # the sum over +1 and -1: twice that over the ones, less that over all
            estimate += alignment[:, k] * (low * (2 * ones - self.components) + step * (2 * met - self.sum[at, None]))
        far = self.length[at, None] * rest + self.error[at, None] * norm + SLACK * (self.length[at, None] * norm + 1)
        return estimate - far, estimate + far


def _best(score: np.ndarray, vec_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best: higher scores first, ties by smaller id."""
    return np.lexsort((vec_id, -score))[:n]


CODED = "row long, vec_id long, label long, x binary, codes binary, alignment binary, rest double, norm double"


def _coded(components: int) -> Callable:
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("x")
            x = np.zeros((len(batch), components), "int32")
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
            made = encode(x)
            raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            columns = [batch.column(c) for c in ("row", "vec_id", "label")] + [raw(x), raw(made["codes"]), raw(made["alignment"]), pa.array(made["rest"]), pa.array(made["norm"])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CODED.split(", ")])

    return run


def _arrays(table: pa.Table, components: int) -> dict[str, np.ndarray]:
    """A block's columns as arrays, its rows sorted by label."""
    table = table.sort_by([("label", "ascending"), ("row", "ascending")])
    read = lambda c, kind, *shape: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(len(table), *shape)
    plain = {c: table.column(c).to_numpy() for c in ("row", "label", "rest", "norm")}
    ids = table.column("vec_id").combine_chunks()
    # a null id comes after all others
    order = pa.compute.fill_null(ids, (1 << 63) - 1).to_numpy()
    return plain | {"vec_id": ids, "order": order, "x": read("x", "int32", components), "codes": read("codes", "uint64", LEVELS, components // 64), "alignment": read("alignment", "float64", LEVELS)}


def _scores(rows: dict, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    return rows["x"][at].astype("int64") @ q.astype("int64")


def _each_anchor(rows: dict, anchors: dict):
    """(anchor, lower ends, upper ends) over all rows, some anchors' estimates held at a time."""
    queries, n = Queries(anchors["x"]), max(1, PAIRS // max(1, len(rows["row"])))
    for first in range(0, len(anchors["row"]), n):
        lower, upper = queries.intervals(slice(first, first + n), rows["codes"], rows["alignment"], rows["rest"], rows["norm"])
        for i in range(len(lower)):
            yield first + i, lower[i], upper[i]


POSITIVES = "anchor long, anchor_id long, row long, positive_id long, positive_score long"


def _positives(components: int, count: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, anchors = _arrays(left, components), _arrays(right, components)
        found = []
        for a, lower, upper in _each_anchor(rows, anchors):
            first, last = np.searchsorted(rows["label"], anchors["label"][a], "left"), np.searchsorted(rows["label"], anchors["label"][a], "right")
            own = np.arange(first, last)
            own = own[rows["row"][own] != anchors["row"][a]]
            if len(own) > count:
                own = own[upper[own] >= np.partition(lower[own], -count)[-count]]
            if len(own):
                score = _scores(rows, own, anchors["x"][a])
                best = _best(score, rows["order"][own], count)
                found.append((np.full(len(best), a), own[best], score[best]))
        a, own, score = (np.concatenate(c) if found else np.zeros(0, "int64") for c in (zip(*found) if found else ((), (), ())))
        columns = [pa.array(anchors["row"][a]), anchors["vec_id"].take(pa.array(a)), pa.array(rows["row"][own]), rows["vec_id"].take(pa.array(own)), pa.array(score)]
        return pa.table(dict(zip([c.split()[0] for c in POSITIVES.split(", ")], columns)))

    return run


NEGATIVES = "anchor long, nth int, negative_id long, negative_score long, row long"


def _negatives(components: int, count: int, least: int, most: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, anchors = _arrays(left, components), _arrays(right, components)
        bands = {row: scores for row, scores in zip(right.column("row").to_pylist(), right.column("scores").to_pylist())}
        found = []
        for a, lower, upper in _each_anchor(rows, anchors):
            other = rows["label"] != anchors["label"][a]
            wanted = []
            for nth, positive in enumerate(bands[int(anchors["row"][a])]):
                low, high = -(-least * positive // 100), most * positive // 100
                may = other & (upper >= low) & (lower <= high)
                sure = lower[may & (lower >= low) & (upper <= high)]
                if len(sure) > count:
                    may &= upper >= np.partition(sure, -count)[-count]
                wanted.append((nth, low, high, np.flatnonzero(may)))
            if not any(len(w[-1]) for w in wanted):
                continue
            every = np.unique(np.concatenate([w[-1] for w in wanted]))
            score = np.zeros(len(other), "int64")
            score[every] = _scores(rows, every, anchors["x"][a])
            for nth, low, high, own in wanted:
                own = own[(score[own] >= low) & (score[own] <= high)]
                best = own[_best(score[own], rows["order"][own], count)]
                found.append((np.full(len(best), a), np.full(len(best), nth), best, score[best]))
        a, nth, own, score = (np.concatenate(c) if found else np.zeros(0, "int64") for c in (zip(*found) if found else ((), (), (), ())))
        columns = [pa.array(anchors["row"][a]), pa.array(nth.astype("int32")), rows["vec_id"].take(pa.array(own)), pa.array(score), pa.array(rows["row"][own])]
        return pa.table(dict(zip([c.split()[0] for c in NEGATIVES.split(", ")], columns)))

    return run


def hard_negatives(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x count as floor(256 * x); a score is the inner product with the anchor. An anchor (a row where
    ``anchors``, over vec_id, is true) has as positives its first other rows of the same label, and for
    each of these the first rows of other labels whose score is between ``least`` and ``most`` hundredths of the
    positive's. Higher scores come first, then smaller ids, null ids last.

    Rows with a null label or vector, or a null, NaN or infinite component, take no part. Shorter vectors count
    as filled up with zeros; an empty one has score 0. Components beyond 2^26 are clipped. Rows with the same id are rows of
    their own, so an anchor may have a copy of itself as a positive, and a null id is never an
    anchor. A positive score of 0 has only scores of 0 in its band, a negative one none. Anchors without positives
    give no rows, and neither does an empty table. Other columns are ignored.
    """
    spark, store = rows.sparkSession, Scratch(rows.sparkSession)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    clean = clean.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    n, anchored, longest = clean.agg(F.count("*"), F.count_if(F.coalesce(anchors, F.lit(False))), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    components = max(64, -(-longest // 64) * 64)
    clipped = F.transform("vector", lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(-float(MOST))), F.lit(float(MOST)))))
    coded = clean.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", clipped.alias("x")).mapInArrow(_coded(components), CODED)
    coded = store.cut(coded)
    row_blocks = max(-(-n // ROWS), SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")))
    anchor_blocks = max(1, -(-anchored // ANCHORS))
    dealt = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    all_blocks = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    # a row meets each block of anchors, an anchor each block of rows
    blocks = coded.withColumn("row_block", dealt(row_blocks)).withColumn("anchor_block", all_blocks(anchor_blocks)).groupBy("anchor_block", "row_block")
    chosen = coded.filter(anchors).toDF(*coded.columns)

    def meet(queries: DataFrame, work: Callable, schema: str) -> DataFrame:
        spread = queries.withColumn("anchor_block", dealt(anchor_blocks)).withColumn("row_block", all_blocks(row_blocks))
        spread = spread.toDF(*spread.columns)  # names of its own, as both sides come from one table
        return blocks.cogroup(spread.groupBy("anchor_block", "row_block")).applyInArrow(lambda a, b: work(a, b) if len(a) and len(b) else _none(schema), schema)

    order = [F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), F.col("row")]
    near = meet(chosen, _positives(components, positives), POSITIVES).withColumn("nth", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
    near = store.cut(near.filter(F.col("nth") <= positives).withColumn("nth", F.col("nth") - 1).drop("row"))
    scores = near.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    order = [F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), F.col("row")]
    far = meet(chosen.join(scores, "row"), _negatives(components, negatives, least, most), NEGATIVES).withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(*order)))
    return far.filter(F.col("rank") <= negatives).drop("row").join(near, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]).empty_table()
