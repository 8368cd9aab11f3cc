"""Sources of a synthesis: passages of several records in turn while a budget lasts, cards of the records, and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.retrieval import top
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, CHUNKS, articles, chunks

# Records of a question, text passages and figures of each, passages and characters of all, characters of one.
RECORDS, TEXTS, FIGURES, ITEMS, CHARACTERS, PASSAGE = 10, 2, 1, 20, 12_000, 1_200


def bounded_evidence(records: DataFrame, passages: DataFrame, items: int = ITEMS, characters: int = CHARACTERS, each: int = PASSAGE) -> DataFrame:
    """``query_id, place, record_id, evidence_id, turn, used, text`` of ``records(query_id, record_id, at)`` and ``passages(record_id, evidence_id, kind, at, text)``.

    A question's first ten records (by ``at``, then id) give their first two passages of text and first figure. The records take turns: first the first passage of each, then the second. Texts are
    trimmed and cut to ``each`` characters, blank ones left out; items are taken while there are fewer than ``items`` and fewer than ``characters``
    characters before them, and the last one is cut to what is left. ``used`` counts the characters before.

    Both cuts come before the turns, and each keeps a few rows a task, so no question's passages are ever gathered.
    """
    first = top(records, ["query_id"], ["at", "record_id"], RECORDS).select("query_id", "record_id", F.col("rank").alias("_record"))
    own = passages.join(first.select("record_id").distinct(), "record_id", "left_semi")
    kinds = top(own, ["record_id", "kind"], ["at", "evidence_id"], max(TEXTS, FIGURES)).where((F.col("kind") == "text") & (F.col("rank") <= TEXTS) | (F.col("kind") == "figure") & (F.col("rank") <= FIGURES))
    turn = F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("kind") == "figure", "rank"))
    own = kinds.withColumn("turn", turn).drop("rank").withColumn("text", F.substring(F.trim("text"), 1, each)).where("text <> ''")
    in_turn = Window.partitionBy("query_id").orderBy("turn", "_record")
    met = first.join(own, "record_id").withColumn("place", F.row_number().over(in_turn))
    met = met.withColumn("used", F.coalesce(F.sum(F.length("text")).over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = met.where((F.col("place") <= items) & (F.col("used") < characters))
    return kept.select("query_id", "place", "record_id", "evidence_id", "turn", "used", F.substring("text", F.lit(1), (characters - F.col("used")).cast("int")).alias("text"))


def synthesis_cards(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, record_id, at, evidence_ids, gap``: each of a question's first ten records with the evidence that was chosen of it, in order, or the gap that it leaves."""
    first = top(records, ["query_id"], ["at", "record_id"], RECORDS).select("query_id", "record_id", F.col("rank").alias("at"))
    chosen = evidence.groupBy("query_id", "record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    met = first.join(chosen, ["query_id", "record_id"], "left")
    return met.withColumn("gap", F.when(F.col("evidence_ids").isNull(), F.concat("record_id", F.lit(": no factual evidence persisted for this question."))))


def stored_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each source and language is a question, its articles the records, the longest first; their lines are passages, those of results figures."""
    records = articles(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("query_id"), F.col("article_id").alias("record_id"), (-F.col("n_chars")).alias("at"))
    kind = F.when(F.col("section") == "results", "figure").otherwise("text")
    return records, chunks(spark, sf_dir).select(F.col("article_id").alias("record_id"), F.col("chunk_id").alias("evidence_id"), kind.alias("kind"), F.col("chunk_index").alias("at"), "text")


EVIDENCE = f"""WITH {ARTICLES}, {CHUNKS}, rc AS (SELECT concat_ws('/', source, lang) AS query_id, article_id AS record_id, row_number() OVER (PARTITION BY concat_ws('/', source, lang) ORDER BY -n_chars, article_id) AS record FROM articles),
 k AS (SELECT *, row_number() OVER (PARTITION BY article_id, section = 'results' ORDER BY chunk_index, chunk_id) AS n FROM chunks WHERE article_id IN (SELECT record_id FROM rc WHERE record <= 10)),
 t AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY section = 'results', n) AS turn FROM k WHERE n <= CASE WHEN section = 'results' THEN 1 ELSE 2 END),
 p AS (SELECT query_id, record, record_id, chunk_id AS evidence_id, turn, substring(trim(text, ' '), 1, 1200) AS text FROM t JOIN rc ON record_id = article_id WHERE record <= 10 AND trim(text, ' ') <> ''),
 o AS (SELECT *, row_number() OVER w AS place, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY turn, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p WINDOW w AS (PARTITION BY query_id ORDER BY turn, record)),
 ev AS (SELECT query_id, place, record, record_id, evidence_id, turn, CAST(used AS BIGINT) AS used, substring(text, 1, CAST(12000 - used AS INTEGER)) AS text FROM o WHERE place <= 20 AND used < 12000)"""


@query("bounded_evidence", EVIDENCE + " SELECT query_id, place, record_id, evidence_id, turn, used, text FROM ev")
def bounded_evidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_evidence(*stored_sources(spark, sf_dir))


@query("synthesis_cards", EVIDENCE + ", c AS (SELECT query_id, record_id, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY place) AS evidence FROM ev GROUP BY query_id, record_id) SELECT rc.query_id, rc.record_id, record AS \"at\", coalesce(evidence, '') AS evidence, CASE WHEN evidence IS NULL THEN rc.record_id || ': no factual evidence persisted for this question.' END AS gap FROM rc LEFT JOIN c ON c.query_id = rc.query_id AND c.record_id = rc.record_id WHERE record <= 10")
def synthesis_cards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, passages = stored_sources(spark, sf_dir)
    rows = synthesis_cards(records, bounded_evidence(records, passages))
    return rows.withColumn("evidence", F.coalesce(F.array_join("evidence_ids", ","), F.lit(""))).drop("evidence_ids")
