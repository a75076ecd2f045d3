"""Registered queries, and the pipeline's stages, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from helixframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, SF).filter("held_out").join(docs, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_quality_against_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op1_quality_classifier"](spark, SF).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.2
    rules = QUERIES["op4_quality_rules"](spark, SF).join(labels, "doc_id").filter("not base_failed and quality = 1").toPandas()
    assert rules.kept.mean() > 0.97


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert sorted(after.columns) == sorted(columns)
        assert 0 < after.count() <= docs.count()
        docs = after.cache()
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(coded) == docs.count() and coded.parity.all() and coded.round_trip.all()


def test_pipeline_stages_on_hard_rows(spark):
    """Null and repeated ids: rows are judged each on its own, and one of each group of copies stays."""
    import random

    rng = random.Random(7)
    text = lambda n: " ".join(f"{rng.choice(['alpha', 'beta', 'gamma'])}{rng.randrange(500)}" for _ in range(n))
    plain = [text(60) for _ in range(30)]
    rows = [(None, t, "en", "s") for t in plain[:10]] + [(5, t, "en", "s") for t in plain[10:20]] + [(i, t, None, None) for i, t in enumerate(plain[20:], 100)]
    copies = [(None, plain[0], "en", "s"), (5, plain[10], "en", "s"), (7, plain[1] + " end", "en", "s"), (8, plain[11] + " end", "de", "t")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows + copies] + [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.dedup(spark, docs, SF).collect()
    assert sorted(r["text"] or "" for r in once if (r["text"] or "") in plain) == sorted(set(plain) - {plain[1]})
    assert [r["doc_id"] for r in once if r["text"] == plain[1] + " end"] == [7] and not any(r["text"] == plain[11] + " end" for r in once)
    assert sum(not r["text"] for r in once) == 3
    kept = corpus_pipeline.rules(spark, docs, SF).collect()
    assert len(kept) == 34 and all(r["text"] for r in kept)
    assert 0 < corpus_pipeline.mixture(spark, docs, SF).count() < docs.count()
    none = docs.limit(0)
    assert [stage(spark, none, SF).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
