"""Ingestion as one job: every file ends with a status, and the ready ones with their chunks; one bad file stops nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import readable_share, title_key
from lodestar.operators.entities import KEY
from lodestar.operators.passages import chunked
from lodestar.operators.texts import READABLE_SQL
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, articles
from lodestar.sources.tables import stored

#: A text that looks less like a text than this needs recognition first (a fixed value).
READABLE_LEAST = 0.75
#: Levels of the duplicate test, the surest first, and the columns that must be equal.
LEVELS = {"hash": ["sha"], "doi": ["doi"], "title": ["key", "year"]}


def filled(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))


def with_least(rows: DataFrame, others: DataFrame, levels: dict[str, list[str]], prefix: str) -> DataFrame:
    """``rows`` with the least id of ``others`` that equal it at each level; nulls equal nothing."""
    for name, keys in levels.items():
        rows = rows.join(filled(others, keys).groupBy(*keys).agg(F.min("id").alias(f"{prefix}_{name}")), keys, "left")
    return rows


def first_of_their_kind(rows: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """``rows(id, …)`` with ``duplicate_of`` and ``reason``, as if they came one after another in order of ``id``.

    A row that equals a taken one before it at some level is a duplicate of the first of these, by the surest level; all others are taken. Rounds settle
    this for all rows at once: who equals a taken row before it is out, who equals no open row before it is taken. So a group of copies of any size takes two
    rounds; only a chain of rows that equal each other alternately takes more. A round is an aggregate and a join a level.
    """
    columns = sorted({c for keys in levels.values() for c in keys})
    live = stored(rows.select("id", *columns), "open")
    taken = live.limit(0)
    i = F.col("id")
    before = lambda prefix: F.greatest(*(F.coalesce((F.col(f"{prefix}_{x}") < i).cast("int"), F.lit(0)) for x in levels), F.lit(0)) == 1
    while live.head(1):
        left = with_least(live, taken, levels, "t").where(~before("t")).select("id", *columns)
        judged = stored(with_least(left, left, levels, "w").withColumn("_first", ~before("w")).select("id", *columns, "_first"), "round")
        taken = taken.unionByName(judged.where("_first").drop("_first"))
        live = judged.where("NOT _first").drop("_first")
    met = with_least(rows.select("id", *columns), stored(taken, "taken"), levels, "t")
    twin, why = F.lit(None).cast("long"), F.lit(None).cast("string")
    for name in reversed(levels):
        hit = F.col(f"t_{name}") < i
        twin, why = F.when(hit, F.col(f"t_{name}")).otherwise(twin), F.when(hit, F.lit(name)).otherwise(why)
    return rows.join(met.select("id", twin.alias("duplicate_of"), why.alias("reason")), "id", "left")


def ingested(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results ``(id, status, error, duplicate_of, reason, n_chunks)`` of every row of ``files(id, body, doi, title, year)``, and the ready files' chunks.

    A file without a body or a title is ``failed``, with the reason as ``error``; one that hardly reads as a text is ``ocr_required``; one that equals a file before it
    by content hash, DOI, or title and year is a ``duplicate`` (:func:`first_of_their_kind`); the others are ``chunks_ready``. Failed and unreadable files make nothing a duplicate.
    """
    body, title = F.col("body"), F.col("title")
    error = F.when(body.isNull() | (F.trim(body) == ""), "no content").when(title.isNull() | (F.trim(title) == ""), "no title")
    judged = files.select("id", "body", F.lower(F.trim("doi")).alias("doi"), "title", "year", error.alias("error"))
    judged = judged.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(readable_share(body) < READABLE_LEAST, "ocr_required"))
    judged = stored(judged.withColumns({"sha": F.sha2("body", 256), "key": title_key(title)}), "judged")
    good = first_of_their_kind(judged.where("status IS NULL").select("id", "sha", "doi", "key", "year"), LEVELS).select("id", "duplicate_of", "reason")
    settled = stored(judged.drop("sha", "key").join(good, "id", "left").withColumn("status", F.coalesce("status", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("chunks_ready"))), "settled")
    lines = settled.where("status = 'chunks_ready'").select(F.col("id").alias("doc_id"), F.posexplode(F.split("body", "\n")).alias("page", "line"))
    units = lines.select("doc_id", "page", F.posexplode(F.split("line", r"(?<=[.!?])\s+(?=[\p{Lu}0-9])")).alias("pos", "text")).where(F.trim("text") != "")
    chunks = stored(chunked(units.withColumn("section", F.lit("body"))), "chunks")
    counts = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    results = settled.select("id", "status", "error", "duplicate_of", "reason").join(counts, "id", "left")
    return results.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long"))), chunks


def least_sql(state: str, prefix: str) -> str:
    def one(name: str, keys: list[str]) -> str:
        least = f"min(CASE WHEN state = '{state}' THEN id END) OVER (PARTITION BY {', '.join(keys)})"
        return f"CASE WHEN {' AND '.join(f'{k} IS NOT NULL' for k in keys)} THEN {least} END AS {prefix}_{name}"

    return ", ".join(one(*x) for x in LEVELS.items())


def rounds_sql(n: int) -> str:
    """``n`` rounds of the duplicate test as SQL, and ``done`` with each row's twin."""
    earlier = lambda prefix: "(" + " OR ".join(f"coalesce({prefix}_{x} < id, false)" for x in LEVELS) + ")"
    parts = ["r0 AS (SELECT id, sha, doi, key, year, 'open' AS state FROM good)"]
    for k in range(n):
        parts.append(f"g{k} AS (SELECT id, sha, doi, key, year, CASE WHEN state = 'open' AND {earlier('t')} THEN 'gone' ELSE state END AS state FROM (SELECT *, {least_sql('taken', 't')} FROM r{k}))")
        parts.append(f"r{k + 1} AS (SELECT id, sha, doi, key, year, CASE WHEN state = 'open' AND NOT {earlier('w')} THEN 'taken' ELSE state END AS state FROM (SELECT *, {least_sql('open', 'w')} FROM g{k}))")
    case = lambda value: "CASE " + " ".join(f"WHEN t_{x} < id THEN {value(x)}" for x in LEVELS) + " END"
    parts.append(f"done AS (SELECT id, state, {case(lambda x: f't_{x}')} AS twin, {case(lambda x: repr(x))} AS why FROM (SELECT *, {least_sql('taken', 't')} FROM r{n}))")
    return ", ".join(parts)


READ = READABLE_SQL.split(" SELECT doc_id, share")[0].replace("WITH ", "", 1)


@query("ingestion_results", f"""WITH {ARTICLES}, {READ}, j AS (SELECT article_id AS id, body, lower(doi) AS doi, title, year, sha256(body) AS sha, {KEY} AS key, share,
 CASE WHEN body IS NULL OR trim(body, ' ') = '' THEN 'no content' WHEN trim(title, ' ') = '' THEN 'no title' END AS error FROM articles JOIN s ON s.doc_id = article_id),
 good AS (SELECT * FROM j WHERE error IS NULL AND share >= {READABLE_LEAST}), {rounds_sql(8)}
SELECT j.id, CASE WHEN j.error IS NOT NULL THEN 'failed' WHEN share < {READABLE_LEAST} THEN 'ocr_required' WHEN twin IS NOT NULL AND state <> 'open' THEN 'duplicate' WHEN state = 'taken' THEN 'chunks_ready' END AS status, j.error, twin AS duplicate_of, why AS reason FROM j LEFT JOIN done ON done.id = j.id""")
def ingestion_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each stored document when all are taken in."""
    files = articles(spark, sf_dir).withColumnRenamed("article_id", "id")
    return ingested(files)[0].drop("n_chunks")
