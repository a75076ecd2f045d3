"""Removal of repeated passages against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import substring_dedup as s

SCHEMA = "doc_id long, text string, doc__ int, spans string"


def brute(rows):
    """(doc_id, n_words, kept words) of rows in order of place."""
    seen, out = set(), []
    for doc_id, text in rows:
        w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
        gone = set()
        for i in range(len(w) - 19):
            own = tuple(w[i : i + 20])
            if own in seen:
                gone.update(range(i, i + 20))
            seen.add(own)
        out.append((doc_id, len(w), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def texts(seed, n):
    """Texts with shared passages, of a few or of many words, and some that repeat themselves."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(rng.choice([3, 3000]))}"
    common = [[word() for _ in range(rng.randint(15, 70))] for _ in range(8)]
    out = []
    for _ in range(n):
        own = []
        for _ in range(rng.randint(0, 6)):
            part = list(rng.choice(common)) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 40))]
            own += part[rng.randrange(4) :] * rng.choice([1, 1, 1, 3])
        out.append("  ".join(own) if rng.random() < 0.95 else None)
    return out


def found(docs):
    return sorted(((r["doc_id"], r["n_words"], r["kept_text"]) for r in s.dedup_passages(docs).collect()), key=repr)


@pytest.mark.parametrize("seed", [1])
def test_passages_match_brute_force(spark, seed):
    rows = list(enumerate(texts(seed, 120), -20)) + [(500, "a " * 300), (501, "b a " * 200), (502, "x y z " * 40), (503, "x y z " * 7)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert found(docs.repartition(7)) == brute(rows)


def test_factors_name_their_sources(spark):
    rows = list(enumerate(texts(9, 60)))
    w = {i: [x for x in re.split(r"[ \t-\r]+", t or "") if x] for i, t in rows}
    got = s.dedup_passages(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert sum(len(r["factors"]) for r in got) > 20
    for r in got:
        for f in r["factors"]:
            assert f["length"] >= 20 and (f["source"], f["source_start"]) < (r["doc_id"], f["start"])
            assert w[r["doc_id"]][f["start"] : f["start"] + f["length"]] == w[f["source"]][f["source_start"] : f["source_start"] + f["length"]]
        assert {i for a, b in r["spans"] for i in range(a, b)} == {i for f in r["factors"] for i in range(f["start"], f["start"] + f["length"])}


def test_hard_rows(spark):
    """Null and repeated ids, repeated rows, texts of several pieces, empty tables."""
    rng = random.Random(4)
    long = [f"v{rng.randrange(10**6)}" for _ in range(9_000)]
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, " ".join(long)), (2, " ".join(["new", *long[2_000:7_000], "end"])), (3, passage), (7, "few words"), (7, ""), (9, None), (None, "q " + passage)]
    twins = [(3, passage), (3, passage), (7, "few words"), (9, None)]
    want = sorted(brute(rows) + [(3, 25, ""), (3, 25, ""), (7, 2, "few words"), (9, 0, "")], key=repr)
    assert found(spark.createDataFrame([(*r, 1, "x") for r in rows + twins], SCHEMA).repartition(5)) == want
    assert s.dedup_passages(spark.createDataFrame([], SCHEMA)).count() == 0


class Held:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("hot", [False, True])
def test_chunks_and_split_seeds(monkeypatch, hot):
    """Windows are looked up across chunks and batches, by seed or, for frequent seeds, each on its own."""
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 4, rng.integers(20, 90)).astype("int64") * 7919 + 1 for _ in range(60)] + [np.full(40, 5, "int64")] * 3
    pieces = [(i, at, d[at : at + 32 + 19]) for i, d in enumerate(docs) for at in range(0, len(d) - 19, 32)]
    rng.shuffle(pieces)
    monkeypatch.setattr(s, "CHUNK", 400)
    batch = lambda own: pa.RecordBatch.from_arrays([pa.array([p[0] for p in own]), pa.array([1] * len(own)), pa.array([p[1] for p in own]), pa.array([p[2].tolist() for p in own], pa.list_(pa.int64()))], names=["doc__", "tie__", "at__", "hashes__"])
    batches = [batch(pieces[i : i + 40]) for i in range(0, len(pieces), 40)]
    seeds = np.unique(np.concatenate([c.column("seed").to_numpy() for c in s._count_seeds(iter(batches))]).view("uint64"))
    every = Held(np.full(1 << 10, ~np.uint64(0)))
    rows = pa.Table.from_batches(s._blocks(iter(batches), every, Held(seeds if hot else seeds[:0]))).sort_by([("key", "ascending"), ("doc", "ascending"), ("tie", "ascending"), ("start", "ascending")])
    got = {(r["doc"], r["start"] + i) for b in s._look_up(iter(rows.to_batches(max_chunksize=13))) for r in b.to_pylist() for i in range(r["n"])}
    seen, want = set(), set()
    for i, d in enumerate(docs):
        for at in range(len(d) - 19):
            own = d[at : at + 20].tobytes()
            if own in seen:
                want.add((i, at))
            seen.add(own)
    assert got == want and want
