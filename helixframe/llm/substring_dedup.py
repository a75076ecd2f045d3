"""Removal of passages that stand earlier, by relative Lempel-Ziv factors (operator 13).

Every document is factored against all documents before it, and against itself:

1. Blocks. A window of 20 words has a seed: the least hash of its 5-word grams. A block is a run of windows
   with one seed. Equal windows have equal seeds, so a seed's blocks hold all places where its windows
   stand: seeds are the index of the reference.
2. Index. Seeds are counted by place, one row a seed and chunk of text; those met once lead to no factor. The others
   are marked in a bitmap of at most ``MOST_BITS`` bits. A seed that shares a bit with another one costs
   a look-up, never a wrong result.
3. Look-up. Blocks with a marked seed meet by seed, in document order, and each of their windows is looked
   up among those before it. A chunk of text sends each window once, whatever the number of
   copies in it, so a passage of a third of all documents has at most a row a chunk. Blocks of
   very frequent seeds are split, and meet by window.
4. Factors. Along a document a factor starts at the first window that has a source and goes on as long as
   the next window's source is the next place of the same document. Windows across a factor's
   end were looked up each on its own: one with a source of its own opens a further factor, that
   overlaps the last. Every factor has 20 words or more, and all its words go.

Windows are compared by 64-bit hashes of 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, small, words

#: Words of a window, and of the grams whose least hash is its seed.
WINDOW, GRAM = 20, 5
#: Windows of a piece: longer documents are cut, each piece going on for WINDOW - 1 words.
PIECE = 2048
#: Words that a Python worker works on at a time.
CHUNK = 500_000
#: Bits of the bitmap for each repeated seed, and in all at most.
BITS_A_SEED, MOST_BITS = 16, 1 << 28
#: A seed with more than this share of all places of repeated seeds, and at least so many, is split.
HOT_SHARE, HOT_LEAST = 20_000, 64
#: Factors up to which those of all documents are broadcast, 40 bytes each; beyond it Spark shuffles.
BROADCAST_FACTORS = 500_000
#: Stands for a null doc_id, which comes last.
LAST = (1 << 63) - 1

_STEP = 0x9E3779B97F4A7C15
FACTORS = "array<struct<start:bigint,length:bigint,source:bigint,source_start:bigint>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place on, by doubling."""
    out, done, power, own = None, 0, h, 1
    while True:
        if size & own:
            if out is None:
                out, done = power, own
            else:
                n = len(h) - done - own + 1
                out = out[:n] * np.uint64(pow(_STEP, own, 1 << 64)) + power[done : done + n]
                done += own
        own *= 2
        if own > size:
            return _mixed(out)
        n = len(h) - own + 1
        power = power[:n] * np.uint64(pow(_STEP, own // 2, 1 << 64)) + power[own // 2 : own // 2 + n]


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of the ``size`` values from each place on."""
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class _Windows:
    """All windows of some pieces, ordered by place: arrays of seed, hash (on demand), piece and start."""

    def __init__(self, batch: pa.RecordBatch):
        doc, tie, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc__", "tie__", "at__"))
        order = np.lexsort((at, tie, doc))
        batch = batch.take(pa.array(order))
        lists = batch.column("hashes__")
        self.h = lists.flatten().to_numpy(zero_copy_only=False).view("uint64")
        sizes = np.diff(lists.offsets.to_numpy())
        self.doc, self.tie, self.at = doc[order], tie[order], at[order]
        self.grams = _grams(self.h, GRAM)
        least = _least(self.grams, WINDOW - GRAM + 1)
        counts = np.maximum(sizes - WINDOW + 1, 0)
        self.piece = np.repeat(np.arange(len(sizes)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = np.repeat(np.cumsum(sizes) - sizes, counts) + inside  # in h
        self.start = self.at[self.piece] + inside
        self.least = least[self.place]
        self.seed = _mixed(self.least)

    def places_of_seeds(self) -> np.ndarray:
        """The seed at each place that has one: a gram that is the least of a window around it. A text that
        repeats itself may have one seed at many places of one block."""
        span = WINDOW - GRAM + 1
        around = np.zeros(len(self.grams) + span - 1, "uint64")
        around[self.place + span - 1] = self.least
        return _mixed(self.grams[~_least(~around, span) == self.grams])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where any column's value is not the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Windows]:
    for batch in batches:
        batch = batch.filter(batch.column("at__").is_valid())
        if not len(batch):
            continue
        ends = np.cumsum(np.diff(batch.column("hashes__").offsets.to_numpy()))
        first = 0
        while first < len(batch):
            held = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, held + CHUNK, "right")))
            yield _Windows(batch.slice(first, last - first))
            first = last


def _count_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _chunks(batches):
        seed, n = np.unique(found.places_of_seeds(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(seed.view("int64")), pa.array(n)], names=["seed", "n"])


RUNS = "key long, doc long, tie long, start long, n long, source long, source_start long, windows array<long>"
#: Null and a list in one: numbers, or none where the mask says so.
_some = lambda values, none: pa.array(values, pa.int64(), mask=none)


def _blocks(batches: Iterator[pa.RecordBatch], marked: Broadcast, hot: Broadcast) -> Iterator[pa.RecordBatch]:
    """Blocks with a marked seed: windows that the chunk has not had before, to be looked up, and runs of
    windows whose source is in the chunk itself."""
    bitmap, frequent = marked.value, hot.value
    down = np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    for found in _chunks(batches):
        bit = found.seed >> down
        taken = np.flatnonzero(bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
        if not len(taken):
            continue
        seed, piece, start = found.seed[taken], found.piece[taken], found.start[taken]
        window = _grams(found.h, WINDOW)[found.place[taken]]
        _, first, own = np.unique(window, return_index=True, return_inverse=True)
        first = first[own]
        doc, tie = found.doc[piece], found.tie[piece]
        # a repeated row is at the same place as its copy, and so has its source nowhere
        again = (doc != doc[first]) | (tie != tie[first]) | (start != start[first])
        source, source_start = np.where(again, doc[first], 0), np.where(again, start[first], 0)
        lone = ~again & np.isin(seed, frequent)
        opens = _changes(piece, seed, again, start - np.arange(len(start)), source, np.where(again, source_start - start, 0)) | lone
        at = np.flatnonzero(opens)
        n = np.diff(np.append(at, len(taken)))
        # what is found already meets nothing, and is spread by its place
        key = np.where(again, _mixed((doc * 31 + start).view("uint64")), np.where(lone, window, seed))[at]
        fresh = ~again
        ends = np.concatenate([[0], np.cumsum(np.where(again[at], 0, n))])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(window[fresh].view("int64")))
        none = ~again[at]
        yield pa.RecordBatch.from_arrays([pa.array(key.view("int64")), pa.array(doc[at]), pa.array(tie[at]), pa.array(start[at]), pa.array(n), _some(source[at], none), _some(source_start[at], none), lists], names=[c.split()[0] for c in RUNS.split(", ")])


FOUND = "doc long, tie long, start long, n long, source long, source_start long"


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that have a source, from blocks sorted by key and place. Of the last key what was seen
    so far is held over to the next batch: one entry for each different window."""
    held_key, held = None, [np.zeros(0, t) for t in ("uint64", "int64", "int64", "int64")]
    for batch in batches:
        known = batch.column("source").is_valid()
        yield batch.filter(known).select(["doc", "tie", "start", "n", "source", "source_start"])
        batch = batch.filter(pa.compute.invert(known))
        if not len(batch):
            continue
        key, doc, tie, start, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "tie", "start", "n"))
        window = batch.column("windows").flatten().to_numpy(zero_copy_only=False).view("uint64")
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        key, doc, tie, start = key[row], doc[row], tie[row], start[row] + step
        values, first, own = np.unique(window, return_index=True, return_inverse=True)
        best = [doc[first], tie[first], start[first]]
        if held_key is not None and held_key == key[0] and len(held[0]):
            at = np.minimum(np.searchsorted(held[0], values), len(held[0]) - 1)
            same = held[0][at] == values
            best = [np.where(same, h[at], b) for h, b in zip(held[1:], best)]
        of_last = key[first] == key[-1]
        kept = [values[of_last], *[b[of_last] for b in best]]
        if held_key is not None and held_key == key[-1]:
            rest = ~np.isin(held[0], kept[0])
            kept = [np.concatenate([a, b[rest]]) for a, b in zip(kept, held)]
            order = np.argsort(kept[0])
            kept = [a[order] for a in kept]
        held_key, held = key[-1], kept
        source, source_tie, source_start = (b[own] for b in best)
        again = np.flatnonzero((source != doc) | (source_tie != tie) | (source_start != start))
        if not len(again):
            continue
        row, doc, tie, start, source, source_tie, source_start = (a[again] for a in (row, doc, tie, start, source, source_tie, source_start))
        at = np.flatnonzero(_changes(row, start - np.arange(len(start)), source, source_tie, source_start - start))
        n = np.diff(np.append(at, len(again)))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (doc[at], tie[at], start[at], n, source[at], source_start[at])], names=["doc", "tie", "start", "n", "source", "source_start"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' runs, sorted by place, to factors and to the disjoint spans that they cover."""
    for batch in batches:
        lists = batch.column("runs")
        n_rows = len(batch)
        start, n, source, source_start = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
        row = np.repeat(np.arange(n_rows), np.diff(lists.offsets.to_numpy()))
        opens = _changes(row, source, source_start - start)
        opens[1:] |= start[1:] != start[:-1] + n[:-1]
        at = np.flatnonzero(opens)
        length = np.add.reduceat(n, at) + WINDOW - 1
        owner, begin = row[at], start[at]
        ends = lambda of: pa.array(np.searchsorted(of, np.arange(n_rows + 1)).astype("int32"))
        factors = pa.StructArray.from_arrays([pa.array(begin), pa.array(length), pa.array(source[at]), pa.array(source_start[at])], names=["start", "length", "source", "source_start"])
        # a span opens where a factor begins beyond all that the document's factors before it reach
        far = int((begin + length).max()) + 1
        reach = np.maximum.accumulate(begin + length + owner * far)
        fresh = _changes(owner)
        fresh[1:] |= (begin + owner * far)[1:] > reach[:-1]
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(begin)) - 1
        spans = pa.StructArray.from_arrays([pa.array(begin[head]), pa.array(reach[tail] - owner[tail] * far)], names=["start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.ListArray.from_arrays(ends(owner), factors), pa.ListArray.from_arrays(ends(owner[head]), spans)], names=["doc", "tie", "factors", "spans"])


def _pieces(named: DataFrame) -> DataFrame:
    """Word hashes of the documents, cut into pieces of bounded length; none below a window's length."""
    hashed = named.select("doc__", "tie__", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    starts = F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(0), F.size("hashes") - WINDOW, F.lit(PIECE)))
    cut_out = F.transform(starts, lambda at: F.struct(at.cast("long").alias("at__"), F.slice("hashes", at + 1, PIECE + WINDOW - 1).alias("hashes__")))
    # the outer form, as else Spark adds a filter that computes the hashes twice
    return hashed.select("doc__", "tie__", F.explode_outer(cut_out).alias("piece")).select("doc__", "tie__", "piece.at__", "piece.hashes__")


def _index(store: Scratch, pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of repeated seeds, and the frequent ones: both of bounded size."""
    counted = pieces.mapInArrow(_count_seeds, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1")
    seeds = store.cut(counted)
    n, places = seeds.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_A_SEED * n).bit_length()))
    bit = F.shiftrightunsigned("seed", 64 - bits.bit_length() + 1)
    filled = seeds.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits.bit_length() + 1}) & 63 as int))").alias("mask"))
    filled = filled.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # MOST_BITS / 64 rows at most
    bitmap = np.zeros(bits // 64, "uint64")
    bitmap[filled.column("word").to_numpy()] = filled.column("mask").to_numpy().view("uint64")
    hot = seeds.filter((F.col("n") >= HOT_LEAST) & (F.col("n") * HOT_SHARE >= places)).select("seed").toArrow()  # HOT_SHARE rows at most
    store.drop(seeds)
    return bitmap, np.sort(hot.column("seed").to_numpy().view("uint64"))


def factored(store: Scratch, named: DataFrame) -> DataFrame:
    """(doc, tie, factors, spans) of each document that has a factor."""
    sc = named.sparkSession.sparkContext
    pieces = _pieces(named)
    bitmap, frequent = _index(store, pieces)
    marked, hot = sc.broadcast(bitmap), sc.broadcast(frequent)
    blocks = pieces.mapInArrow(lambda batches: _blocks(batches, marked, hot), RUNS)
    met = blocks.repartition("key").sortWithinPartitions("key", "doc", "tie", "start")
    runs = met.mapInArrow(_look_up, FOUND).groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("start", "n", "source", "source_start"))).alias("runs"))
    return store.cut(runs.mapInArrow(_parse, f"doc long, tie long, factors {FACTORS}, spans array<struct<start:bigint,end:bigint>>"))


def without_spans(items: Column, spans: Column) -> Column:
    """The items outside the spans (start, end; sorted, disjoint), in order."""
    n = F.size(items).cast("long")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(n))
    return F.flatten(F.zip_with(begins, stops, lambda a, b: F.slice(items, (a + 1).cast("int"), (b - a).cast("int"))))


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, factors (start, length, source, source_start), spans
    (start, end) and kept_text.

    A word (a run without ASCII white space) is removed if a window of 20 consecutive words of the document
    covers it whose words also start earlier: in a row with a smaller ``doc_id``, or earlier in the
    same one. Windows are judged on the input. ``factors`` name an earlier place (``source`` is a
    doc_id) of each removed stretch, and may overlap; ``spans`` are their union. kept_text
    has the other words, joined by one space.

    Null ids come last (as sources they show as null). Rows with the same id and different texts are ordered by a hash
    of the text; of rows alike in both, one is as it would be alone and the others repeat it wholly,
    if it has 20 words or more. Null texts have no words; texts of any length are taken whole, in
    pieces. An empty table gives an empty one; other columns are ignored.
    """
    store = Scratch(docs.sparkSession)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("doc__"), F.xxhash64(F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit(""))).alias("tie__"))
    found = factored(store, named)
    size = found.agg(F.coalesce(F.sum(F.size("factors") + 1), F.lit(0))).first()[0]
    whole = named.select("doc_id", "doc__", "tie__", words(F.col("text")).alias("words")).join(small(found.toDF("doc__", "tie__", "factors", "spans"), size, BROADCAST_FACTORS), ["doc__", "tie__"], "left")
    kept = F.when(F.col("spans").isNull(), F.col("words")).otherwise(without_spans(F.col("words"), F.col("spans")))
    none = lambda name: F.coalesce(F.col(name), F.array().cast(dict(found.dtypes)[name]))
    shown = lambda f: F.struct(f["start"], f["length"], F.nullif(f["source"], F.lit(LAST)).alias("source"), f["source_start"])
    rows = whole.select("doc__", "tie__", "doc_id", F.size("words").cast("long").alias("n_words"), F.transform(none("factors"), shown).cast(FACTORS).alias("factors"), none("spans").alias("spans"), F.array_join(kept, " ").alias("kept_text"))
    names = rows.columns[2:]
    repeated = store.cut(named.groupBy("doc__", "tie__").agg(F.count("*").alias("copies")).filter("copies > 1"))
    n = repeated.count()
    if not n:
        return rows.select(*names)
    marked = rows.join(small(repeated, n, BROADCAST_FACTORS), ["doc__", "tie__"], "left")
    copies = marked.filter("copies IS NOT NULL").dropDuplicates(["doc__", "tie__"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    again = (F.col("copy") > 1) & (F.col("n_words") >= WINDOW)
    start = F.lit(0).cast("long")
    wholly = {
        "factors": F.array(F.struct(start.alias("start"), F.col("n_words").alias("length"), F.col("doc_id").cast("long").alias("source"), start.alias("source_start"))).cast(FACTORS),
        "spans": F.array(F.struct(start.alias("start"), F.col("n_words").alias("end"))),
        "kept_text": F.lit(""),
    }
    copies = copies.withColumns({c: F.when(again, col).otherwise(F.col(c)) for c, col in wholly.items()})
    return marked.filter("copies IS NULL").select(*names).unionByName(copies.select(*names))
