"""The engine's logical tables over the stored ones: articles, chunks, queries, records, runs, jobs.

Each binding is a projection that Spark folds into the scan. The SQL texts beside them say the same
for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import token_count
from lodestar.sources.tables import table

STATUSES = ["validated", "indexed", "awaiting_validation", "rejected", "metadata_only"]
VISIBLE = ["validated", "indexed"]
SECTIONS = ["abstract", "introduction", "methods", "results", "discussion", "conclusion", "other"]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``article_id, title, body, lang, source, n_chars, year, status, doi``: a document each, the first line its title."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("article_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        "lang",
        "source",
        "n_chars",
        (1990 + i % 35).cast("int").alias("year"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (i % 5 + 1).cast("int")).alias("status"),
        F.when(i % 3 != 0, F.concat(F.lit("10.5555/ls."), F.floor(i / 2).cast("string"))).alias("doi"),
    )


ARTICLES = """articles AS (SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, text AS body, lang, source, n_chars,
  CAST(1990 + doc_id % 35 AS INTEGER) AS year, (['validated','indexed','awaiting_validation','rejected','metadata_only'])[CAST(doc_id % 5 + 1 AS INTEGER)] AS status,
  CASE WHEN doc_id % 3 <> 0 THEN '10.5555/ls.' || CAST(doc_id // 2 AS VARCHAR) END AS doi FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, article_id, chunk_index, section, text``: the non-blank lines of the documents."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.where(F.trim("text") != "").select(
        (F.col("article_id") * 100000 + F.col("i")).alias("chunk_id"),
        "article_id",
        F.col("i").cast("long").alias("chunk_index"),
        F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("i") % 7 + 1).cast("int")).alias("section"),
        "text",
    )


CHUNKS = """chunks AS (SELECT article_id * 100000 + i AS chunk_id, article_id, CAST(i AS BIGINT) AS chunk_index,
  (['abstract','introduction','methods','results','discussion','conclusion','other'])[CAST(i % 7 + 1 AS INTEGER)] AS section, text
  FROM (SELECT doc_id AS article_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(text, ' ') <> '')"""


def with_token_count(rows: DataFrame) -> DataFrame:
    return rows.withColumn("token_count", token_count(F.col("text")).cast("long"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query``: the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def record_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, record_id, theme, rank, score, status``: an order line each, its supplier the theme, its part the record."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("record_id"),
        F.concat(F.lit("theme"), (F.col("l_suppkey") % 7).cast("string")).alias("theme"),
        F.col("l_linenumber").cast("long").alias("rank"),
        F.col("l_discount").alias("score"),
        F.when(F.col("l_discount") >= 0.07, "accepted").when(F.col("l_discount") >= 0.045, "review").otherwise("rejected").alias("hit_status"),
    )


HITS = """hits AS (SELECT l_orderkey AS run_id, l_partkey AS record_id, 'theme' || CAST(l_suppkey % 7 AS VARCHAR) AS theme, CAST(l_linenumber AS BIGINT) AS rank, l_discount AS score,
  CASE WHEN l_discount >= 0.07 THEN 'accepted' WHEN l_discount >= 0.045 THEN 'review' ELSE 'rejected' END AS hit_status FROM lineitem)"""

#: DuckDB for the folding of ``functions.text``.
FOLD = "replace(strip_accents(lower({x})), 'ß', 'ss')"
TOKENS = r"regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}]+')"
