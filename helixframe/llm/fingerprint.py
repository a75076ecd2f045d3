"""Quartile bucket digests of texts (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import cut

#: Buckets of a digest; two bits each.
BUCKETS = 256
#: Pairs of offsets of the two other bytes of a triplet, seen from its first one.
OFFSETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_STEP = 1 << 18


def _bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the hashed triplets of the bytes."""
    counts = np.zeros(BUCKETS, "int64")
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for start in range(0, len(data), _STEP):
        part = np.frombuffer(data, "uint8", min(_STEP + 4, len(data) - start), start).astype("uint32")
        for salt, (a, b) in enumerate(OFFSETS):
            n = min(_STEP, len(part) - b)
            if n > 0:
                mixed = (part[:n] | part[a : a + n] << np.uint32(8) | part[b : b + n] << np.uint32(16) | np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
                counts += np.bincount((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> shift, minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """Hexadecimal digest: two digits of length, then two bits for each bucket.

    The length is a step on a logarithmic scale of UTF-8 bytes. A bucket's bits say how many
    of the three quartiles of all bucket counts its own count exceeds. Texts with fewer than
    three bytes hit no bucket and have a digest of zeros after the length.
    """
    data = text.encode("utf-8", "surrogatepass")
    counts = _bucket_counts(data)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(1).astype("uint8").reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, round(8 * np.log2(1 + len(data))))
    return f"{length:02x}{packed.tobytes().hex()}"


def difference(left: str, right: str, length_cap: int = 48) -> int:
    """Bounded difference score: each bucket adds the distance of its two codes, 6 if they lie
    at opposite ends; the length adds its steps beyond one, ``length_cap`` at most."""
    a, b = (np.frombuffer(bytes.fromhex(x[2:]), "uint8") for x in (left, right))
    steps = sum(_APART[(a >> s & 3) * 4 + (b >> s & 3)].sum() for s in (0, 2, 4, 6))
    apart = abs(int(left[:2], 16) - int(right[:2], 16))
    return int(steps) + min(length_cap, max(0, apart - 1))


_APART = np.array([0, 1, 2, 6, 1, 0, 1, 2, 2, 1, 0, 1, 6, 2, 1, 0], "int64")
#: Texts in different languages differ by about this much; a likeness of 0 lies here.
UNLIKE = 2 * BUCKETS


def likeness(left: str, right: str) -> float:
    """1 for equal digests, falling to 0 at a difference of ``UNLIKE`` or more."""
    return 1.0 - min(difference(left, right), UNLIKE) / UNLIKE


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` plus the digest of each whole text; a null text counts as empty."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(t if isinstance(t, str) else "") for t in texts], dtype="object")

    return docs.withColumn(out, made(F.col(text)))


def likeness_column(left: Column, right: Column) -> Column:
    """The likeness of two digest columns; null if either is null."""

    @F.pandas_udf("double")
    def made(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")

    return made(left, right)


SIDE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("part", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _pair(doc_id, text: str, own: str, following: str, next_digest: str) -> tuple:
    import hashlib

    cut_at = len(text) - len(text) // 3
    edited = text[:cut_at] + following[: len(text) // 3]
    other = digest(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, next_digest)


def edit_study(docs: DataFrame, partitions: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's digest against those of its edited copy and of the next document.

    Documents are taken by descending ``doc_id`` (then by descending text, for repeated ids; null
    ids last) and the first follows the last. The edited copy has its last third replaced by
    the beginning of the next document. Texts are dealt by range once and each task walks
    through its sorted range holding two rows, so no window over all rows is needed; only the
    first and last rows of the ranges meet in a second, narrow step. A null text counts as
    empty. A lone document is followed by itself; an empty table gives no rows.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    # ranges of ids alone: their bounds come from a sample of keys, which should hold no texts
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("string").alias("key")).repartitionByRange(partitions, order[0]).sortWithinPartitions(*order)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, first = TaskContext.get().partitionId(), None, True
        blank = (None,) * 6
        for frame in frames:
            rows = []
            for key, body in zip(frame["key"], frame["text"]):
                own = digest(body)
                if first:
                    rows.append((key, len(body), None, own, None, None, None, part, "head", body))
                    first = False
                if last:
                    rows.append((*_pair(last[0], last[1], last[2], body, own), part, "done", None))
                last = key, body, own
            yield pd.DataFrame(rows, columns=SIDE.names)
        if last:
            yield pd.DataFrame([(last[0], *blank[1:3], last[2], *blank[:3], part, "tail", last[1])], columns=SIDE.names)

    walked = cut(dealt.mapInPandas(walk, SIDE))
    heads = walked.filter("role = 'head'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("next_digest"))
    # one narrow row for each range of the partitioning, whatever the number of documents
    parts = heads.select("part").withColumn("after", F.lead("part").over(Window.orderBy("part"))).withColumn("after", F.coalesce("after", F.min("part").over(Window.partitionBy(F.lit(0)))))
    seams = walked.filter("role = 'tail'").select("part", "doc_id", "text", "fingerprint").join(parts, "part").join(heads.withColumnRenamed("part", "after"), "after")

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_pair(*row) for row in zip(frame["doc_id"], frame["text"], frame["fingerprint"], frame["following"], frame["next_digest"])], columns=SIDE.names[:7])

    done = walked.filter("role = 'done'").select(*SIDE.names[:7])
    return done.unionByName(seams.mapInPandas(close, T.StructType(SIDE.fields[:7]))).withColumn("doc_id", F.col("doc_id").cast("long"))
