"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch


def components(links: DataFrame, store: Scratch | None = None) -> DataFrame:
    """``links`` (a, b; longs) to (node, root): every node that has a link, with the smallest
    node that it can reach. Loops and repeated links are allowed; nulls are ignored.

    Alternates two steps until nothing changes: each node links its larger neighbours to its
    smallest one, then its smaller ones. A node's neighbours are never gathered: the smallest
    is an aggregate, joined back, so a node may have any number of links.
    """
    store = store or Scratch(links.sparkSession)
    now = store.cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        kept = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        before, now = now, store.cut(kept)
        store.drop(before)
        seen = now.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))").alias("hash")).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = seen
