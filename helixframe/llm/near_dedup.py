"""Near-duplicate groups from bottom-k sketches of one hash function (operator 7).

Texts with equal shingle sets form a class first; one member stands for it. From then on:

1. A class is sketched by its ``k`` smallest shingle hashes. Of two sets of similarity t, each
   of the k smallest hashes of the union lies in both with probability t, and then in both
   sketches. ``shared_at_least`` gives the number of common values that such a pair has but
   for a chance of 1e-9; sets of at most ``k`` shingles are their own sketch, and exact.
2. A class can only have a partner if that many of its values are in other sketches too.
   Of those values it enters the rarest ones in inverted lists, so many that two partners must
   meet in one of them (the more frequent ones, such as those of a passage in thousands of
   texts, are not needed).
   A set of which no other candidate holds most shingles is dropped, and its shingles held by others are counted.
3. In a short list every pair is a candidate. In a long list each member is first compared with
   one, the list's centre: the set with the fewest shingles of its own. Members that come into the
   centre's component need no more comparisons with each other. The others are compared with
   those of their list that lie in another component and that counts allow to be linked (see
   ``_open_pairs``). So a group of copies costs one comparison a member, and no link is lost.
   Where very many members of a list stay open (``CROWDED``), as with texts put together from a few
   common passages, they enter second lists by bands (the smallest values of their set in another
   order, see ``_bands``) or, as small sets, by choices of their values (``_subset_keys``); these are
   treated in the same way.
4. The union sketch's estimate drops candidate pairs; the whole sets decide the rest.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import Scratch, lower_ascii, pairwise, small, words
from helixframe.llm.components import components

#: Values of a sketch.
K = 32
#: Members up to which a list gives all its pairs.
SHORT = 24
#: Similarity in hundredths.
SIMILAR = 80
#: Rows of a few numbers each, some 100 bytes in memory, up to which a table is broadcast.
BROADCAST_ROWS = 250_000
#: Open members of a long list up to which each is paired with all others of its list.
OPEN = 256
#: Pairs of open and all members of a long list up to which counts alone decide which are compared.
CROWDED = 2_000_000
#: Bands of a set, the smallest values in each, and the shingles from which on sets have bands: two sets
#: of similarity 0.8 and a union of 20 or more have no band in common with a chance below 1e-9.
BANDS, IN_BAND, BANDED = 90, 6, 20
#: Values of a smaller set that make a key.
SUBSET = 6


@lru_cache(maxsize=8)
def shared_at_least(k: int, similar: int = SIMILAR, chance: float = 1e-9) -> int:
    """The largest s for which fewer than s of k draws succeed with at most ``chance``."""
    t, below, s = similar / 100, 0.0, 0
    while True:
        below += math.comb(k, s) * t**s * (1 - t) ** (k - s)
        if below > chance:
            return s
        s += 1


def shingle_hashes(text: Column, size: int) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last, ``set__``, is the sorted array of distinct
    hashes of the text's shingles of ``size`` words (4 or 5), empty without words."""
    steps = [("words__", words(lower_ascii(text))), ("one__", F.transform("words__", lambda w: F.xxhash64(w))), ("two__", pairwise(F.col("one__"), 1)), ("four__", pairwise(F.col("two__"), 2))]
    many = F.col("four__")
    if size == 5:
        rest = F.greatest(F.size("one__") - 4, F.lit(0))
        many = F.zip_with(F.slice("four__", 1, rest), F.slice("one__", 5, rest), lambda a, b: F.xxhash64(a, b))
    elif size != 4:
        raise ValueError("shingles have four or five words")
    few = F.array(F.xxhash64(F.lit("short"), F.array_join("words__", " ")))
    every = F.when(F.size("words__") == 0, F.expr("cast(array() as array<bigint>)")).when(F.size("words__") < size, few).otherwise(many)
    return [*steps, ("all__", every), ("set__", F.sort_array(F.array_distinct("all__")))]


def with_sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    for name, col in shingle_hashes(F.col(text), size):
        docs = docs.withColumn(name, col)
    return docs.drop("words__", "one__", "two__", "four__", "all__", text)


def _needed(n: Column, k: int) -> Column:
    """Values that a sketch of a set of n shingles shares with a partner's at least."""
    exact = F.ceil(n * SIMILAR / 100).cast("int")
    return F.when(n <= k, F.least(exact, F.lit(shared_at_least(k)))).otherwise(F.lit(shared_at_least(k)))


def _pairs_of(lists: DataFrame, by: list[str]) -> DataFrame:
    """All pairs (a, b) of members of lists (…, cid, n, root) that are not in one component yet; the
    caller gives short lists only."""
    heads = lists.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cid", "n", "root"))).alias("members"))
    pair = F.flatten(F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, F.size("members")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = heads.select(F.explode(pair).alias("pair"))
    # neither may be so much smaller that the sizes alone forbid a link
    alike = F.least("pair.x.n", "pair.y.n") * 100 >= F.greatest("pair.x.n", "pair.y.n") * SIMILAR
    return pairs.filter(alike & (F.col("pair.x.root") != F.col("pair.y.root"))).select(F.col("pair.x.cid").alias("a"), F.col("pair.y.cid").alias("b"))


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int) -> DataFrame:
    """Drops pairs whose union sketch has too few common values. Two sets of at most ``k`` shingles
    are their own sketches: all their common values count, against the whole union."""
    own = sketches.select("cid", "n", "sketch")
    both = pairs.distinct().join(own.toDF("a", "n_a", "sketch_a"), "a").join(own.toDF("b", "n_b", "sketch_b"), "b")
    every = F.array_union("sketch_a", "sketch_b")
    shared = F.array_intersect("sketch_a", "sketch_b")
    sampled = F.size(F.array_intersect(F.slice(F.sort_array(every), 1, k), shared))
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    common = F.when(whole, F.size(shared)).otherwise(sampled)
    least = F.when(whole, F.ceil(F.size(every) * SIMILAR / 100)).otherwise(F.lit(shared_at_least(k)))
    return both.filter(common >= least).select("a", "b")


def _linked(store: Scratch, pairs: DataFrame, sketches: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The pairs that are links: by estimate, then by the whole sets of those that are left."""
    likely = store.cut(_estimated(pairs, sketches, k))
    n = likely.count()
    named = likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    own = sets.join(F.broadcast(named), "cid", "left_semi") if n <= BROADCAST_ROWS else sets
    both = likely.join(own.select(F.col("cid").alias("a"), F.col("set__").alias("set_a")), "a").join(own.select(F.col("cid").alias("b"), F.col("set__").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    linked = store.cut(both.filter(100 * common >= SIMILAR * (F.size("set_a") + F.size("set_b") - common)).select("a", "b"))
    store.drop(likely)
    return linked


def _open_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a group (center, cid, n, shared, common, root, center_root) that are
    in different components, one of them outside the centre's, and that may be linked: what two
    sets have in common lies in the centre, where the smaller share bounds it, or outside,
    where what other sets hold of each does."""
    names = ("n", "shared", "common", "root")
    x = groups.filter("root <> center_root").select("center", F.col("cid").alias("a"), *[F.col(c).alias(f"{c}_a") for c in names])
    y = groups.select("center", F.col("cid").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names], (F.col("root") != F.col("center_root")).alias("outside"))
    most = F.least("common_a", "common_b") + F.least(F.col("shared_a") - F.col("common_a"), F.col("shared_b") - F.col("common_b"))
    fits = (100 + SIMILAR) * most >= SIMILAR * (F.col("n_a") + F.col("n_b"))
    once = ~F.col("outside") | (F.col("a") < F.col("b"))
    return x.join(y, "center").filter(fits & once & (F.col("root_a") != F.col("root_b"))).select("a", "b")


@lru_cache(maxsize=64)
def _subsets(n: int, r: int) -> np.ndarray:
    return np.array(list(combinations(range(n), r)))


def _subset_keys(values: np.ndarray) -> np.ndarray:
    """Keys of a small set, such that any two that are linked have one in common: for each size that the
    larger of the two may have, how many values both share is known (``need``). Their first ``r`` common
    values are among each one's first n - need + r, so each choice of r of those is a key."""
    n, keys = len(values), []
    mixed = values.view("uint64")
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.sort(mixed ^ mixed >> np.uint64(29))
    for larger in range(n, min(n * 100 // SIMILAR, BANDED * 100 // SIMILAR - 1) + 1):
        need = -(-larger * SIMILAR // 100)
        if 0 < need <= n:
            r = min(need, SUBSET)
            key = np.full(1, larger, "uint64")
            for column in mixed[_subsets(n - need + r, r)].T:
                key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
                key = key ^ key >> np.uint64(32)
            keys.append(key)
    return np.concatenate(keys).view("int64") if keys else np.zeros(0, "int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def subset_keys(sets: pd.Series) -> pd.Series:
    return pd.Series([_subset_keys(np.asarray(s, "int64")) for s in sets])


def _bands(sets: DataFrame) -> DataFrame:
    """(value, cid) for each of ``BANDS`` orders of the hashes: what the ``IN_BAND`` smallest values of a
    set are in that order. Smaller sets, which can only be linked with ones of fewer than 25
    shingles, meet those by ``_subset_keys``, without any chance of loss."""
    order = lambda i: F.slice(F.sort_array(F.transform("set__", lambda v: F.xxhash64(v, i))), 1, IN_BAND)
    bands = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda i: F.xxhash64(i, order(i)))
    large = sets.filter(F.size("set__") >= BANDED).select(F.explode(bands).alias("value"), "cid")
    few = sets.filter(F.size("set__") * SIMILAR < BANDED * 100)
    return large.unionByName(few.select(F.explode(subset_keys("set__")).alias("value"), "cid"))


def _by_lists(store: Scratch, members: DataFrame, sketches: DataFrame, sets: DataFrame, known: DataFrame | None, k: int, short: int, last: bool) -> DataFrame:
    """All links that come from lists (value, cid, n, shared, root), as (a, b), such that their components
    and those of ``known`` are the components of all links between members of one list.
    Members of one root are in one component already, by ``known``."""
    center = F.max(F.struct((F.col("shared") - F.col("n")).alias("most"), F.col("n"), F.col("cid"))).alias("center")
    sizes = store.cut(members.groupBy("value").agg(F.count("*").alias("m"), center).filter("m > 1").select("value", "m", F.col("center.cid").alias("center")))
    listed = members.join(small(sizes, sizes.count(), BROADCAST_ROWS), "value")
    every = _linked(store, _pairs_of(listed.filter(F.col("m") <= short), ["value"]), sketches, sets, k)
    groups = store.cut(listed.filter(F.col("m") > short).select("center", "cid", "n", "shared").distinct())
    if known is not None:
        every = every.unionByName(known)
    if groups.isEmpty():
        return every
    compared = groups.join(sets.select("cid", "set__"), "cid").join(sets.select(F.col("cid").alias("center"), F.col("set__").alias("set_c"), F.col("n").alias("n_c")), "center")
    compared = store.cut(compared.withColumn("common", F.size(F.array_intersect("set__", "set_c"))).drop("set__", "set_c"))
    star = compared.filter(f"cid <> center AND {100 + SIMILAR} * common >= {SIMILAR} * (n + n_c)").select(F.col("center").alias("a"), F.col("cid").alias("b"))
    so_far = store.cut(components(every.unionByName(star), store))
    rooted = compared.join(so_far.toDF("cid", "root"), "cid", "left").join(so_far.toDF("center", "center_root"), "center", "left")
    rooted = store.cut(rooted.withColumn("root", F.coalesce("root", "cid")).withColumn("center_root", F.coalesce("center_root", "center")))
    every = so_far.select(F.col("node").alias("a"), F.col("root").alias("b"))
    crowded = (F.col("open") > OPEN) & (F.col("open") * F.col("m") > CROWDED) & F.lit(not last)
    counts = store.cut(rooted.groupBy("center").agg(F.count_if(F.col("root") != F.col("center_root")).alias("open"), F.count("*").alias("m")).filter("open > 0").select("center", crowded.alias("crowded")))
    counted = rooted.join(small(counts, counts.count(), BROADCAST_ROWS), "center")
    every = every.unionByName(_linked(store, _open_pairs(counted.filter("NOT crowded")), sketches, sets, k))
    if counts.filter("crowded").isEmpty():
        return every
    again = store.cut(counted.filter("crowded").select("cid", "n", "shared", "root").distinct())
    banded = store.cut(_bands(sets.join(again.select("cid"), "cid", "left_semi")).join(again, "cid"))
    return _by_lists(store, banded, sketches, sets, every, k, short, True)


def near_duplicates(docs: DataFrame, size: int = 5, doc_id: str = "doc_id", text: str = "text", k: int = K, short: int = SHORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, first and row_key.

    Two documents are linked if their sets of ``size``-word shingles (A-Z lower-cased, words
    parted by ASCII white space, a shorter text being one shingle) have a Jaccard similarity of
    0.8 or more. component_id is the smallest doc_id that can be reached, kept says that it is
    the row's own. Texts without words, and null texts, are linked with nothing. Repeated rows
    are in one component, each a row. Rows with a null doc_id are linked as others are; their
    component_id is null, and kept true, only where no row of the component has an id.
    ``first`` is true for exactly one row of each component, and for every row without words:
    also where ids are null or repeated. ``row_key`` is ``row_key()`` of the row.
    """
    store = Scratch(docs.sparkSession)
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # 128 bits and the size name a set; rows without words get a name of their own, so none are gathered
    one, two = F.xxhash64("set__"), F.xxhash64(F.lit(7), F.reverse("set__"))
    sketched = with_sets(taken.withColumn("row_key", row_key("doc_id", "text")), "text", size)
    base = store.cut(sketched.select("doc_id", "row_key", F.monotonically_increasing_id().alias("row"), F.size("set__").cast("long").alias("n"), F.slice("set__", 1, k).alias("sketch"), one.alias("h1"), two.alias("h2")))
    same = ["h1", "h2", "n"]
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep")
    classes = store.cut(base.filter("n > 0").groupBy(*same).agg(rep, F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()))
    rows = store.cut(base.drop("sketch"))
    store.drop(base)

    entries = classes.select("cid", "n", F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    lists = entries.join(common, "value").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    need = _needed(F.col("n"), k)
    lists = lists.filter(F.size("shared") >= need).select("cid", "n", F.explode(F.slice("shared", 1, F.size("shared") - need + 1)).alias("x")).select("cid", "n", F.col("x.value").alias("value"))
    lists = store.cut(lists)
    # whole sets of the classes that may have a partner, made again from their texts
    met = lists.join(lists.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1"), "value", "left_semi").select("cid").distinct()
    wanted = store.cut(met.join(classes.select("cid", "rep.doc_id", *same), "cid"))
    n_wanted = wanted.count()
    ids = wanted.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    some = taken.join(small(ids, n_wanted, BROADCAST_ROWS), "doc_id", "left_semi")
    if not wanted.filter("doc_id IS NULL").isEmpty():
        some = some.unionByName(taken.filter("doc_id IS NULL"))
    made = with_sets(some, "text", size).withColumns({"h1": one, "h2": two, "n": F.size("set__").cast("long")})
    sets = store.cut(made.join(small(wanted.select("cid", *same), n_wanted, BROADCAST_ROWS), same).select("cid", "n", "set__"))
    if sets.count() > n_wanted:  # the same row is there more than once
        every = sets
        sets = store.cut(every.dropDuplicates(["cid"]))
        store.drop(every)

    # shingles that no other of these sets holds can't be common to two: sets with too many go
    held = sets.select("cid", F.explode("set__").alias("value"))
    lonely = held.groupBy("value").agg(F.min("cid").alias("cid"), F.max("cid").alias("last")).filter("cid = last").groupBy("cid").agg(F.count("*").alias("alone"))
    shared = F.col("n") - F.coalesce("alone", F.lit(0))
    shares = store.cut(sets.select("cid", "n").join(lonely, "cid", "left").select("cid", shared.alias("shared")).filter(100 * shared >= SIMILAR * F.col("n")))
    members = store.cut(lists.join(small(shares, shares.count(), BROADCAST_ROWS), "cid").withColumn("root", F.col("cid")))
    store.drop(lists)
    links = _by_lists(store, members, classes, sets, None, k, short, False)
    roots = store.cut(components(links, store))
    store.drop(members, sets)
    # classes without links are their own component; only the others are put together
    named = roots.join(classes.select("cid", "rep"), roots["node"] == classes["cid"]).select("cid", "root", "rep")
    least = store.cut(named.groupBy("root").agg(F.min("rep").alias("least")))
    of = named.join(small(least, least.count(), BROADCAST_ROWS), "root").select("cid", "least")
    of = store.cut(classes.join(of, "cid", "left").select(*same, F.coalesce("least", "rep").alias("least")))
    store.drop(classes)
    out = rows.filter("n > 0").join(of, same).unionByName(rows.filter("n = 0"), allowMissingColumns=True)
    component = F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    first = F.when(F.col("n") > 0, F.col("row") == F.col("least.row")).otherwise(F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"), "row_key")


def row_key(*columns: str) -> Column:
    """Tells rows apart by their id and text, also where ids are null or repeated."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00none")) for c in columns])
