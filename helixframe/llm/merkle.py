"""Merkle manifests of datasets with nested-interval labels (operator 12).

Rows of a group are leaves in order; every eight consecutive nodes have one parent, up to one node, the
group's subroot. Subroots are the leaves of a further tree, whose last node is the root.
A node's label is the interval of leaf ranks that it covers, [lo, hi). So

* the ancestor of a node at a level is the one whose interval holds the node's: an equi-join on the bucket
  ``lo div width`` of that level, with containment as its condition;
* siblings are what is left of the parent's interval without the node's: children that end before it
  stand to the left, children that begin after it to the right.

Ranks come from ranges: leaves are dealt by range, numbered within each, and the ranges' counts are added
up, so no task holds a group. Levels are written one after the other, each an eighth of the last.
Paths are handed down from the root, eight children sharing what lies above their parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, small

#: Children of a node.
FAN = 8
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ranges of a group, of three numbers and a key each, up to which their counts are broadcast.
BROADCAST_RANGES = 100_000
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the value's UTF-8 bytes, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*said), 256)


@dataclass
class Tree:
    """Nodes of all groups by level; each has group__, size__ (leaves of the group), lo, hi and digest, those
    above the leaves also kids (lo, hi, digest), sorted."""

    levels: list[DataFrame]

    def tops(self, level: int) -> DataFrame:
        """Nodes of a level that are the last of their group."""
        nodes = self.levels[level].filter(F.col("size__") <= FAN**level)
        return nodes.filter(F.col("size__") > FAN ** (level - 1)) if level else nodes

    def roots(self) -> DataFrame:
        """(group__, digest) of each group's last node."""
        found = [self.tops(level).select("group__", "digest") for level in range(len(self.levels))]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        return found[0]

    def paths(self, above: DataFrame) -> DataFrame:
        """Leaves with their ``path`` (left, right; concatenated digests of the siblings, level by level
        upwards, followed by the path that ``above`` (group__, path, ...) has for the group), and with
        all other columns of ``above``."""
        down = None
        for level in range(len(self.levels) - 1, -1, -1):
            # children are needed below; digests of inner nodes are in their parents' children
            own = self.levels[level].drop("digest") if level else self.levels[level]
            last = self.tops(level).join(above, "group__").select(*own.columns, *[c for c in above.columns if c != "group__"])
            down = last if down is None else self._attach(own, level, down).unionByName(last)
        return down

    def _attach(self, nodes: DataFrame, level: int, parents: DataFrame) -> DataFrame:
        width = FAN ** (level + 1)
        up = parents.select(F.col("group__"), F.expr(f"lo div {width}").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("kids").alias("kin"), *[c for c in parents.columns if c not in ("group__", "size__", "lo", "hi", "kids")])
        inside = nodes.withColumn("bucket", F.expr(f"lo div {width}")).join(up, ["group__", "bucket"]).filter("lo >= from AND hi <= to")
        joined = lambda condition: F.array_join(F.transform(F.filter("kin", condition), lambda k: k["digest"]), "")
        step = F.struct(joined(lambda k: k["hi"] <= F.col("lo")).alias("left"), joined(lambda k: k["lo"] >= F.col("hi")).alias("right"))
        return inside.withColumn("path", F.concat(F.array(step), F.col("path")).cast(PATH)).drop("bucket", "from", "to", "kin")


def ranked(store: Scratch, rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with lo (their rank in ``group__`` by ``order``, from 0), hi and size__ (rows of the group).
    Rows alike in all of ``order`` are dealt to several ranges, so that none is too large."""
    by = [F.col("group__"), *order, F.col("salt__")]
    dealt = rows.withColumn("salt__", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = store.cut(dealt.drop("salt__").withColumn("row__", F.monotonically_increasing_id()))
    part = F.shiftright("row__", 33).alias("part__")
    counts = numbered.groupBy("group__", part).agg(F.min("row__").alias("low__"), F.count("*").alias("n__"))
    group = Window.partitionBy("group__")
    before = F.coalesce(F.sum("n__").over(group.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = store.cut(counts.select("group__", "part__", (before - F.col("low__")).alias("shift__"), F.sum("n__").over(group).alias("size__")))
    found = numbered.withColumn("part__", part).join(small(counts, counts.count(), BROADCAST_RANGES), ["group__", "part__"])
    return store.cut(found.withColumn("lo", F.col("row__") + F.col("shift__")).withColumn("hi", F.col("lo") + 1).drop("part__", "row__", "shift__"))


def grow(store: Scratch, leaves: DataFrame) -> Tree:
    """The tree over ranked leaves (group__, size__, lo, hi, digest, ...)."""
    levels = [leaves]
    most = leaves.agg(F.max("size__")).first()[0] or 0
    while FAN ** (len(levels) - 1) < most:
        level = len(levels)
        below = levels[-1].filter(F.col("size__") > FAN ** (level - 1))
        # eight children at most
        runs = below.groupBy("group__", "size__", F.expr(f"lo div {FAN**level}").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))
        digest = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
        levels.append(store.cut(runs.select("group__", "size__", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), digest.alias("digest"), "kids")))
    return Tree(levels)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: the ``order`` column, leaf, subroot, root, path, and ``given``, the digest
    of what a checker holds: the leaf, or where ``tampered`` is true the digest of the row with A-Z of the
    last field lower-cased.

    Groups (``lang``) are trees of their own; a null group is one, and comes first. Leaves
    ascend by ``order``, null first; rows with the same value by their digests, so that repeated rows are
    leaves side by side. An only leaf is its subroot, an only subroot the root; both have no
    siblings. Empty and null texts are leaves like others. An empty table gives an empty one.
    Other columns of ``docs`` are ignored. ``fold`` recomputes a root from a digest and a path.
    """
    store = Scratch(docs.sparkSession)
    cols = [F.col(f) for f in fields]
    leaf = leaf_digest(*cols)
    lower = F.translate(cols[-1].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    given = leaf if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(*cols[:-1], lower)).otherwise(leaf)
    named = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null before all others
    narrow = store.cut(docs.select(named.alias("group__"), F.col(order).alias("key__"), leaf.alias("digest"), given.alias("given")))
    trees = grow(store, ranked(store, narrow, [F.col("key__").asc_nulls_first(), F.col("digest")]))
    subroots = store.cut(trees.roots())
    upper = grow(store, ranked(store, subroots.select(F.lit(0).alias("group__"), F.col("group__").alias("name__"), "digest"), [F.col("name__")]))
    root = upper.roots().select("group__", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("digest").alias("root"))
    above = store.cut(upper.paths(root).select(F.col("name__").alias("group__"), "path", F.col("digest").alias("subroot"), "root"))
    return trees.paths(above).select(F.col("key__").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", "given")


def fold(digest: Column, path: str = "path") -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof_digest(path: str = "path") -> Column:
    """SHA-256 of all siblings' digests, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)
