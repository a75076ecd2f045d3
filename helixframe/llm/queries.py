"""Registered queries of the text operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import chat_format, fingerprint, hard_negatives, language_id, license_scan, merkle, mixing, near_dedup, piece_codec, quality_classifier, quality_rules, substring_dedup, token_counts
from helixframe.llm.common import cut, read


def piece_model_path() -> str:
    """The model file that the installed package of public tokenizers holds."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    """As many ranges as the session's shuffles have partitions, and at least one a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, keep=("doc_id",)).select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()))
    return language_id.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=("doc_id", "held_out"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(read(spark, sf_dir, "documents"), piece_model_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_study(read(spark, sf_dir, "documents"), partitions(spark))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


#: Target shares of languages, and powers of the token shares of sources and topics.
LANGUAGES = {"en": 0.40, "de": 0.20, "es": 0.20, "fr": 0.20}
POWERS = {"source": 0.85, "topic": 0.9}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    narrow = cut(mixing.with_topics(docs, tokens_out="n_tokens", keep=("doc_id", "source", "lang")))
    mixed = mixing.mix(narrow, ("source", "lang", "topic"), F.col("n_tokens"), {"lang": LANGUAGES}, POWERS)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = F.lit(r"\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    chats = chat_format.read_back(chat_format.format_chats(rows.unionByName(own)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, piece_model_path())
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.manifest(docs, tampered=tampered).withColumn("folded_root", merkle.fold(F.col("given")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup_passages(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_language_id, op3_sentencepiece, op4_quality_rules, op5_license_scan, op6_fingerprints, op7_near_duplicates, op8_mixing, op9_chat_format, op10_token_counts, op11_hard_negatives, op12_merkle_manifest, op13_substring_dedup, pipeline)
}

_NEAR_DUPLICATES = r"""
WITH RECURSIVE
word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM word),
shingle AS (SELECT doc_id, unnest(s) AS x FROM sets),
own AS (SELECT DISTINCT doc_id, md5(x) AS x FROM shingle),
pair AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n_both
  FROM own p JOIN own q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id),
link AS (
  SELECT a, b FROM pair JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n_both >= 80 * (len(p.s) + len(q.s) - n_both)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id
"""

_CHATS = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '(\\*)(### |</turn>|</part>)', '\\\1\2', 'g')) + 9
    + CASE WHEN before = role THEN 0 ELSE length(role) + 6 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

_MANIFEST = r"""
WITH RECURSIVE
crc(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
doc AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc_table),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS given FROM doc)),
node(lvl, lang, i, n, digest) AS (
  SELECT 0, lang, rank, n, leaf FROM leaf
  UNION ALL SELECT lvl + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lvl, lang, i // 8, n),
run AS (SELECT lvl, lang, i // 8 AS p, list(digest ORDER BY i) AS kids FROM node WHERE n > 1 GROUP BY lvl, lang, i // 8),
sub AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM node WHERE n = 1),
up(lvl, i, n, digest) AS (
  SELECT 0, rank, n, subroot FROM sub
  UNION ALL SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lvl, i // 8, n),
top AS (SELECT lvl, i // 8 AS p, list(digest ORDER BY i) AS kids FROM up WHERE n > 1 GROUP BY lvl, i // 8),
walk(lang, rank, lvl, i, n, held, proof) AS (
  SELECT lang, rank, 0, rank, n, given, '' FROM leaf
  UNION ALL
  SELECT w.lang, w.rank, w.lvl + 1, w.i // 8, (w.n + 7) // 8,
    sha256(array_to_string(kids[1:w.i % 8], '') || held || array_to_string(kids[w.i % 8 + 2:], '')),
    proof || array_to_string(kids[1:w.i % 8], '') || array_to_string(kids[w.i % 8 + 2:], '')
  FROM walk w JOIN run r ON r.lvl = w.lvl AND r.lang IS NOT DISTINCT FROM w.lang AND r.p = w.i // 8 WHERE w.n > 1),
climb(lang, rank, lvl, i, n, held, proof) AS (
  SELECT w.lang, w.rank, 0, s.rank, s.n, held, proof FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.lang, w.rank, w.lvl + 1, w.i // 8, (w.n + 7) // 8,
    sha256(array_to_string(kids[1:w.i % 8], '') || held || array_to_string(kids[w.i % 8 + 2:], '')),
    proof || array_to_string(kids[1:w.i % 8], '') || array_to_string(kids[w.i % 8 + 2:], '')
  FROM climb w JOIN top r ON r.lvl = w.lvl AND r.p = w.i // 8 WHERE w.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, u.digest AS root, sha256(c.proof) AS proof_sha256, c.held AS folded_root, c.held = u.digest AS verified
FROM leaf l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang JOIN climb c ON c.lang IS NOT DISTINCT FROM l.lang AND c.rank = l.rank AND c.n = 1, (SELECT digest FROM up WHERE n = 1) u
"""

_PASSAGES = r"""
WITH word AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
place AS (SELECT doc_id, unnest(range(1, CAST(len(w) - 18 AS BIGINT))) AS i, w FROM word WHERE len(w) >= 20),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM place),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i
  FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
own AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM word),
kept AS (SELECT own.doc_id, string_agg(x, ' ' ORDER BY own.i) AS t FROM own ANTI JOIN gone ON own.doc_id = gone.doc_id AND own.i = gone.i GROUP BY own.doc_id)
SELECT word.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM word LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op11_hard_negatives": _NEGATIVES, "op13_substring_dedup": _PASSAGES, "op12_merkle_manifest": _MANIFEST, "op7_near_duplicates": _NEAR_DUPLICATES, "op9_chat_format": _CHATS}
