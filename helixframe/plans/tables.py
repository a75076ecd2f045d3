"""The logical tables, derived from the given ones: Spark SQL here, DuckDB text in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two motifs of the queries: name -> probabilities of A, C, G, T by position. Fixed values.
MOTIFS = {
    "MA0004.1 Arnt": [(0.2, 0.8, 0.0, 0.0), (0.95, 0.0, 0.05, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0)],
    "MA0006.1 Ahr::Arnt": [(0.125, 0.333333, 0.083333, 0.458333), (0.0, 0.0, 0.958333, 0.041667), (0.0, 0.958333, 0.0, 0.041667), (0.0, 0.0, 0.958333, 0.041667), (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0)],
}
SIZE = 1_002_000
CHUNK = 16
#: Letters of a sequence: a text's letters are cut into so many, and the last piece takes the rest of fewer than
#: as many more, so that no letter is left out.
TILE = 200

SQL = {
    "intervals": """SELECT l_orderkey*10+l_linenumber AS id, concat('chr', cast(s%22+1 AS varchar(9))) AS chrom,
 (p*7919+l_orderkey*104729)%1000000 AS istart, (p*7919+l_orderkey*104729)%1000000+100+q*20 AS iend,
 CASE WHEN f='A' THEN '-' ELSE '+' END AS strand
 FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, min(l_partkey) AS p,
 min(cast(l_quantity AS bigint)) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber) t""",
    "blacklist": """SELECT s_suppkey AS id, concat('chr', cast((s_suppkey*7)%22+1 AS varchar(9))) AS chrom,
 (s_suppkey*79190+4000)%900000 AS istart, (s_suppkey*79190+4000)%900000+3000+(s_suppkey%5)*1000 AS iend FROM supplier""",
    "sequences": """SELECT doc_id*1000000+t AS id, CASE WHEN t = n-1 THEN substring(s, t*200+1) ELSE substring(s, t*200+1, 200) END AS seq, lang
 FROM (SELECT doc_id, lang, s, greatest(length(s)//200, 1) AS n FROM (SELECT doc_id, lang, regexp_replace(upper(text),'[^ACGT]','','g') AS s FROM documents) WHERE length(s) > 0),
 generate_series(0, 100000) g(t) WHERE t < n""",
    "matrix": "SELECT l_suppkey AS obs, l_partkey AS var, cast(sum(l_quantity) AS double) AS value FROM lineitem GROUP BY l_suppkey, l_partkey",
    "variants": """SELECT p_partkey AS id, concat('chr', cast(p_partkey%22+1 AS varchar(9))) AS chrom,
 (p_partkey*15485863)%1000000+1 AS pos, substring('ACGTN', cast(p_size%5+1 AS int), 1) AS ref,
 substring('CGTA-', cast(p_partkey%5+1 AS int), 1) AS alt FROM part""",
    "preds": """SELECT o_orderkey AS id, o_orderpriority AS task, cast(o_totalprice/600000.0 AS double) AS pred,
 CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS label FROM orders""",
}


def _table(spark: SparkSession, sf_dir: str, name: str, source: str) -> DataFrame:
    """The derivation's SQL over a DataFrame of the source table, in Spark's dialect."""
    return spark.sql(SQL[name].replace(",'','g')", ",'')").replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def _coords(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"istart": "start", "iend": "end"})


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coords(_table(spark, sf_dir, "intervals", "lineitem"))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coords(_table(spark, sf_dir, "blacklist", "supplier"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, s): all letters A, C, G, T of each text that has any. A filter of what is left of a text, also Spark's
    own of nulls, would take it out a second time."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.upper("text").rlike("[ACGT]"))
    return texts.select("doc_id", "lang", F.coalesce(F.regexp_replace(F.upper("text"), "[^ACGT]+", ""), F.lit("")).alias("s"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, lang): all letters A, C, G, T of each text in pieces of 200 to 399 (a shorter text in one)."""
    texts = letters(spark, sf_dir)
    n = F.greatest(F.floor(F.length("s") / TILE), F.lit(1))
    last, at = F.col("t") == n - 1, (F.col("t") * TILE + 1).cast("int")
    # the outer form, of ranges that are never empty: with the other, Spark adds a filter that takes the letters a second time
    pieces = texts.withColumn("t", F.explode_outer(F.sequence(F.lit(0), (n - 1).cast("long"))))
    size = F.when(last, F.length("s")).otherwise(F.lit(TILE))
    return pieces.select((F.col("doc_id") * 1_000_000 + F.col("t")).alias("id"), F.substring(F.col("s"), at, size).alias("seq"), "lang")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "matrix", "lineitem")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "variants", "part")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "preds", "orders")


def sizes(spark: SparkSession) -> DataFrame:
    return spark.range(1, 23).select(F.concat(F.lit("chr"), "id").alias("chrom"), F.lit(SIZE).cast("long").alias("size"))


def motifs(spark: SparkSession) -> DataFrame:
    rows = [(name, pos, base, prob) for name, cells in MOTIFS.items() for pos, cell in enumerate(cells) for base, prob in zip("ACGT", cell)]
    return spark.createDataFrame(rows, "motif string, pos int, base string, prob double")


def motifs_sql() -> str:
    rows = [f"('{name}',{pos},'{base}',{prob}::double)" for name, cells in MOTIFS.items() for pos, cell in enumerate(cells) for base, prob in zip("ACGT", cell)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) m(motif, pos, base, prob)"


def windows(seqs: DataFrame) -> DataFrame:
    """One 25-letter window in each sequence, which counts as a chromosome of its own."""
    start = (F.col("id") * 37) % (F.length("seq") - 30)
    return seqs.select("id", F.concat(F.lit("doc"), "id").alias("chrom"), start.alias("start"), (start + 25).alias("end"), F.when(F.col("id") % 2 == 0, "-").otherwise("+").alias("strand"))
