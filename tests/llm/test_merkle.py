"""Merkle manifests against a plain tree over lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, kids string, path int"


def h(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row, lower=False):
    fields = list(row[:5])
    if lower and fields[4] is not None:
        fields[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in fields[4])
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(digests):
    """The last node, and each leaf's siblings by level."""
    paths, where, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[i].append((run[: at % 8], run[at % 8 + 1 :]))
        level = [h("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
        where = [at // 8 for at in where]
    return level[0], paths


def plain(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: climb([leaf(r) for r in groups[x]]) for x in langs}
    root, tops = climb([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        for r, path in zip(groups[x], trees[x][1]):
            at = leaf(r, tampered(r))
            for left, right in path + top:
                at = h("".join([*left, at, *right]))
            out.append((r[0], leaf(r), trees[x][0], root, h("".join("".join(a + b) for a, b in path + top)), at))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    odd = lambda r: r[0] is not None and r[0] & 1 == 1
    got = merkle.manifest(docs, tampered=F.expr("doc_id & 1 = 1"))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof"), merkle.fold(F.col("given")).alias("folded"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, odd)


@pytest.mark.parametrize("n", [1, 9, 520])
def test_manifest_matches_plain_tree(spark, n):
    rng = random.Random(n)
    langs = ["en"] * 6 + ["de", "é", None, "zz"]
    check(spark, [(i * 3 - 40, rng.choice(["web", None]), rng.choice(langs), rng.choice([None, i]), rng.choice(["A b\nC", "", None, "ÄÖ x", "🙂" * 50])) for i in range(n)])


def test_manifest_on_hard_rows(spark):
    """Null and repeated ids, repeated rows, very long texts, many groups of one, empty tables."""
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "Same")] * 20 + [(5, "s", "en", 1, "Other"), (7, "s", "en", 9, "Long " * 200_000)]
    check(spark, rows + [(100 + i, "s", f"l{i}", 1, "x") for i in range(70)])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tampering_is_seen(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "Text A" if i % 2 else "text", "x", 3) for i in range(30)], SCHEMA)
    rows = merkle.manifest(docs, tampered=F.lit(True)).withColumn("same", merkle.fold(F.col("given")) == F.col("root")).collect()
    assert sorted(r["doc_id"] for r in rows if not r["same"]) == list(range(1, 30, 2))
    assert len({r["leaf"] for r in rows}) == 30
