"""A corpus pipeline over the text operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame. ``run`` writes each stage's rows to Parquet in the session's shared folder and reads
them again as the next stage's docs, so a lost executor costs one stage's tasks at most.

Rows are told apart by a key over their columns, not by doc_id: rows with a null doc_id, and different
texts under one doc_id, are judged each on its own in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import mixing, near_dedup, piece_codec, quality_classifier, quality_rules
from helixframe.llm.common import Scratch, cut, small
from helixframe.llm.queries import LANGUAGES, POWERS, piece_model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys of dropped rows, of 8 bytes each, up to which they are broadcast; beyond it Spark shuffles.
BROADCAST_KEYS = 1_000_000


def _without(docs: DataFrame, key: tuple[str, ...], dropped: DataFrame) -> DataFrame:
    """The rows of docs whose key is not in ``dropped`` (row_key)."""
    dropped = cut(dropped.select("row_key").distinct())
    return docs.withColumn("row_key", near_dedup.row_key(*key)).join(small(dropped, dropped.count(), BROADCAST_KEYS), "row_key", "left_anti").select(*COLUMNS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject."""
    return quality_classifier.classify(docs).filter("quality_kept").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source. Rows
    alike in all columns have one verdict. Verdicts are written without texts."""
    judged = quality_rules.quality_rules(docs.withColumn("row_key", near_dedup.row_key(*COLUMNS)), keep=("row_key",))
    return _without(docs, tuple(COLUMNS), judged.filter("NOT kept"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Of rows with equal id and
    text one stays; documents without words are no copies of each other and all stay."""
    keys = cut(near_dedup.near_duplicates(docs, size=5).groupBy("row_key").agg(F.max("first").alias("first"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles")))
    left = _without(docs, ("doc_id", "text"), keys.filter("NOT first"))
    repeated = keys.filter("first AND n > 1 AND n_shingles > 0").select("row_key")
    n = repeated.count()
    if not n:
        return left
    marked = left.withColumn("row_key", near_dedup.row_key("doc_id", "text")).join(small(repeated.withColumn("again", F.lit(True)), n, BROADCAST_KEYS), "row_key", "left")
    # only rows that are there more than once are shuffled
    return marked.filter("again IS NULL").unionByName(marked.filter("again").dropDuplicates(["row_key"])).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half of all tokens, by probabilities that bring languages to their target shares and
    sources and topics nearer to each other."""
    with_topic = mixing.with_topics(docs, out="topic__", tokens_out="tokens__")
    powers = {"source": POWERS["source"], "topic__": POWERS["topic"]}
    mixed = mixing.mix(with_topic, ("source", "lang", "topic__"), F.col("tokens__"), {"lang": LANGUAGES}, powers, key=("doc_id", "text"))
    return mixed.filter("mix_kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, each document's decoding checked."""
    return piece_codec.encode(docs, piece_model_path())


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near-duplicates", dedup), ("mixing", mixture), ("sentencepiece", encode)]

#: The fitted classifier, the robust estimates and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    store = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, store.cut(stage(spark, docs, sf_dir))
        store.drop(before)
    return docs
