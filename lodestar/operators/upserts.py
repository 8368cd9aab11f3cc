"""Harvested hits into the record table, as one job: who is whom, what each record becomes, what stays as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import title_key
from lodestar.operators.entities import KEY
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, VISIBLE, articles

#: Fields of which a record keeps the first value that says something, in the order of arrival.
FIRST = ["journal", "work_type", "publisher", "year", "url"]
#: A title that stands for a missing one (a fixed value) yields to any other.
NO_TITLE = "Titre indisponible"
#: Decisions that a person took; no hit changes them.
MANUAL = ["manual_accepted", "manual_rejected"]
# How decisions of equal score rank.
RANKS = {"accepted": 2, "review": 1, "rejected": 0}


def said(x: Column) -> Column:
    """The value, or null if it is blank."""
    return F.when(F.trim(x.cast("string")) != "", x)


def grouped(rows: DataFrame) -> DataFrame:
    """``rows(place, doi, title, year)`` with ``doi`` in lower case, ``key`` and ``grp``; rows of one group are one record.

    Equal DOIs are one record. A row without a DOI is the one that its title key and year name: that of the first
    row with a DOI among those of the key and year, if there is one, else their own. So a chain of any length, of rows that share
    a DOI and rows that share a title with one of them, is one group, and a group never has two DOIs. A missing year equals a missing year only.
    Two aggregates find the groups: a row with a DOI never waits for another, so there are no rounds.
    """
    rows = rows.withColumns({"doi": said(F.lower(F.trim("doi"))), "key": title_key(F.coalesce("title", F.lit(""))), "_year": F.coalesce("year", F.lit(-1))})
    anchor = rows.where("doi IS NOT NULL").groupBy("key", "_year").agg(F.min_by("doi", "place").alias("_anchor"))
    named = rows.join(anchor, ["key", "_year"], "left")
    by_title = F.concat_ws(":", F.lit("title"), "key", F.coalesce(F.col("year").cast("string"), F.lit("unknown")))
    return named.withColumn("grp", F.coalesce(F.concat(F.lit("doi:"), F.coalesce("doi", "_anchor")), by_title)).drop("_anchor", "_year")


def content_hash(*fields: str) -> Column:
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def folded(rows: DataFrame) -> DataFrame:
    """One row of each ``grp``: what its rows in order of ``place`` make of it.

    The first DOI, title (a stand-in for a missing one does not count) and other fields that say something, the longest abstract (of equal ones the
    first), all authors in order of first mention, the most citations. Every part is an aggregate that Spark combines before it shuffles; only a
    record's distinct authors are ever gathered.
    """
    first = lambda c: F.min_by(said(F.col(c)), F.when(said(F.col(c)).isNotNull(), F.col("place")))
    title = F.when(F.col("title") != NO_TITLE, said(F.col("title")))
    own = rows.groupBy("grp").agg(
        F.min_by("doi", F.when(F.col("doi").isNotNull(), F.col("place"))).alias("doi"),
        F.coalesce(F.min_by(title, F.when(title.isNotNull(), F.col("place"))), first("title")).alias("title"),
        F.max_by(said(F.col("abstract")), F.when(said(F.col("abstract")).isNotNull(), F.struct(F.length("abstract").alias("n"), (-F.col("place.kind")).alias("k"), (-F.col("place.id")).alias("i")))).alias("abstract"),
        F.max("citations").alias("citations"),
        *(first(c).alias(c) for c in FIRST),
    )
    named = rows.select("grp", F.col("place"), F.posexplode("authors").alias("at", "author")).where(F.trim("author") != "")
    named = named.groupBy("grp", "author").agg(F.min(F.struct("place", "at")).alias("first"))
    lists = named.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "author"))), lambda x: x["author"]).alias("authors"))
    merged = own.join(lists, "grp", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    return merged.withColumn("content_hash", content_hash("doi", "title", "abstract", "authors", "journal", "year", "citations"))


def upserted(records: DataFrame, hits: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """The record table after ``hits``, a row of each record, old ones without a hit too.

    ``records(id long, …, status, decision, score)`` and ``hits(id long, …, decision, score)`` share the fields ``doi, title, abstract, authors, citations`` and
    :data:`FIRST`; old records come before hits, each in order of ``id``. ``excluded(doi)`` hits are left out.

    * Who is whom: :func:`grouped`. What a record becomes: :func:`folded`. It keeps the ``id`` of its first old record, else it has none and ``canonical_key`` names it.
    * The index status sticks while the content is that of the old record; other content is ``pending``, or ``not_applicable`` without an abstract.
    * The decision sticks if a person took it (:data:`MANUAL`), else that with the highest score counts; of equal scores the most favourable.
    """
    hits = hits.withColumn("doi", said(F.lower(F.trim("doi"))))
    if excluded is not None:
        hits = hits.join(excluded.select(F.lower(F.trim("doi")).alias("doi")).distinct(), "doi", "left_anti")
    fields = ["doi", "title", "abstract", "authors", "citations", *FIRST, "score", "decision", "place"]
    both = records.withColumn("place", F.struct(F.lit(0).alias("kind"), "id")).select(*fields, "status").unionByName(hits.withColumn("place", F.struct(F.lit(1).alias("kind"), "id")).select(*fields, F.lit(None).cast("string").alias("status")))
    rows = grouped(both)
    old = F.col("place.kind") == 0
    alone = folded(rows.where(old).withColumn("grp", F.concat_ws("#", "grp", F.col("place.id").cast("string"))))
    own = rows.where(old).select(F.concat_ws("#", "grp", F.col("place.id").cast("string")).alias("grp"), F.col("grp").alias("_of"), "place", "status")
    before = own.join(alone.select("grp", F.col("content_hash").alias("_hash")), "grp").groupBy(F.col("_of").alias("grp")).agg(F.min_by(F.struct("status", "_hash"), "place").alias("_was"))
    rank = F.coalesce(F.create_map(*(F.lit(v) for p in RANKS.items() for v in p))[F.col("decision")], F.lit(-1))
    manual = F.col("decision").isin(MANUAL)
    counts = rows.groupBy("grp").agg(
        F.min(F.when(old, F.col("place.id"))).alias("id"),
        (F.count_if(old)).alias("n_old"),
        F.count_if(~old).alias("n_hits"),
        F.coalesce(F.min_by("decision", F.when(manual, F.col("place"))), F.max_by("decision", F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), rank.alias("r")))).alias("decision"),
        F.max("score").alias("score"),
    )
    full = folded(rows).join(counts, "grp").join(before, "grp", "left")
    fresh = F.when(F.col("abstract").isNotNull(), "pending").otherwise("not_applicable")
    status = F.when(F.col("_was._hash") == F.col("content_hash"), F.col("_was.status")).otherwise(fresh)
    return full.withColumn("status", status).drop("_was").withColumnRenamed("grp", "canonical_key")


def hit_matches(records: DataFrame, hits: DataFrame) -> DataFrame:
    """``(id, canonical_key, matched_by)`` of each hit: what it shares with a row before it.

    In order: its DOI, its title key and year, the same but the row before had no DOI and the hit has one (``provisional``), only the group, which a later
    hit joined (``chain``), or nothing (``new``).
    """
    fields = ["doi", "title", "year", "place"]
    both = records.withColumn("place", F.struct(F.lit(0).alias("kind"), "id")).select(*fields).unionByName(hits.withColumn("place", F.struct(F.lit(1).alias("kind"), "id")).select(*fields))
    rows = grouped(both).withColumn("_year", F.coalesce("year", F.lit(-1)))
    for name, keys in (("_doi", ["doi"]), ("_title", ["grp", "key", "_year"]), ("_grp", ["grp"])):
        known = rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.min("place").alias(name))
        rows = rows.join(known, keys, "left")
    bare = rows.where("doi IS NULL").groupBy("grp", "key", "_year").agg(F.min("place").alias("_bare"))
    rows = rows.join(bare, ["grp", "key", "_year"], "left")
    at, has = F.col("place"), F.col("doi").isNotNull()
    why = F.when(has & (F.col("_doi") < at), "doi").when(~has & (F.col("_title") < at), "title").when(has & (F.col("_bare") < at), "provisional").when(F.col("_grp") < at, "chain").otherwise("new")
    return rows.where("place.kind = 1").select("place.id", F.col("grp").alias("canonical_key"), why.alias("matched_by"))


def harvest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records and hits of the stored documents: visible articles are records, all others hits; authors are a title's first words."""
    score = (F.col("n_chars") % 100) / 100
    judged = F.when(score >= 0.7, "accepted").when(score >= 0.4, "review").otherwise("rejected")
    rows = articles(spark, sf_dir).select(
        F.col("article_id").alias("id"), "doi", "title", F.col("body").alias("abstract"), F.slice(F.split("title", " "), 1, 3).alias("authors"), F.col("n_chars").alias("citations"),
        F.col("source").alias("journal"), F.lit(None).cast("string").alias("work_type"), F.lit(None).cast("string").alias("publisher"), "year", F.lit(None).cast("string").alias("url"),
        score.alias("score"), F.when(F.col("status") == "validated", "manual_accepted").otherwise(judged).alias("decision"), "status",
    )
    return rows.where(F.col("status").isin(VISIBLE)), rows.where(~F.col("status").isin(VISIBLE)).drop("status")


ROWS = f"""{ARTICLES}, a AS (SELECT article_id AS id, CASE WHEN status IN ('validated', 'indexed') THEN 0 ELSE 1 END AS kind, lower(doi) AS doi, title, {KEY} AS key, year, body, source, lang, n_chars, status,
  (n_chars % 100) / 100 AS score, CASE WHEN status = 'validated' THEN 'manual_accepted' WHEN n_chars % 100 >= 70 THEN 'accepted' WHEN n_chars % 100 >= 40 THEN 'review' ELSE 'rejected' END AS decision FROM articles),
anchor AS (SELECT key, year, arg_min(doi, (kind, id)) AS anchor FROM a WHERE doi IS NOT NULL GROUP BY key, year),
g AS (SELECT a.*, coalesce('doi:' || coalesce(doi, anchor), 'title:' || a.key || ':' || a.year) AS grp FROM a LEFT JOIN anchor ON a.key = anchor.key AND a.year = anchor.year)"""


@query("harvest_upsert", f"""WITH {ROWS},
w AS (SELECT grp, kind, id, unnest(string_split(title, ' ')[1:3]) AS author, unnest(range(1, len(string_split(title, ' ')[1:3]) + 1)) AS pos FROM g),
n AS (SELECT grp, author, min((kind, id, pos)) AS place FROM w WHERE trim(author) <> '' GROUP BY grp, author),
l AS (SELECT grp, string_agg(author, '|' ORDER BY place) AS authors FROM n GROUP BY grp),
f AS (SELECT grp, min(id) FILTER (kind = 0) AS id, arg_min(doi, (kind, id)) FILTER (doi IS NOT NULL) AS doi, arg_min(title, (kind, id)) FILTER (trim(title) <> '') AS title,
  arg_max(body, (length(body), -kind, -id)) FILTER (trim(body) <> '') AS body, max(n_chars) AS citations, arg_min(source, (kind, id)) FILTER (trim(source) <> '') AS journal, arg_min(year, (kind, id)) AS year,
  count(*) FILTER (kind = 0) AS n_old, count(*) FILTER (kind = 1) AS n_hits, max(score) AS score,
  coalesce(arg_min(decision, (kind, id)) FILTER (decision = 'manual_accepted'), arg_max(decision, (score, CASE decision WHEN 'accepted' THEN 2 WHEN 'review' THEN 1 WHEN 'rejected' THEN 0 ELSE -1 END))) AS decision,
  arg_min(struct_pack(doi := doi, title := CASE WHEN trim(title) <> '' THEN title END, body := CASE WHEN trim(body) <> '' THEN body END, n_chars := n_chars, source := source, year := year, status := status,
    authors := coalesce(array_to_string(list_filter(list_distinct_in_order, lambda x: trim(x) <> ''), '|'), '')), (kind, id)) FILTER (kind = 0) AS was
  FROM (SELECT *, list_transform(list_filter(list_zip(string_split(title, ' ')[1:3], range(1, 4)), lambda p: p[1] IS NOT NULL AND list_position(string_split(title, ' ')[1:3], p[1]) = p[2]), lambda p: p[1]) AS list_distinct_in_order FROM g) GROUP BY grp)
SELECT f.grp AS canonical_key, id, doi, title, sha256(body) AS abstract_sha256, coalesce(authors, '') AS authors, citations, journal, year, n_old, n_hits, decision, round(score, 4) AS score,
  CASE WHEN was IS NOT NULL AND was.doi IS NOT DISTINCT FROM doi AND was.title IS NOT DISTINCT FROM title AND was.body IS NOT DISTINCT FROM body AND was.n_chars IS NOT DISTINCT FROM citations AND was.source IS NOT DISTINCT FROM journal
    AND was.year = year AND was.authors = coalesce(authors, '') THEN was.status WHEN body IS NOT NULL THEN 'pending' ELSE 'not_applicable' END AS status
FROM f LEFT JOIN l ON f.grp = l.grp""")
def harvest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table after a harvest."""
    rows = upserted(*harvest(spark, sf_dir))
    return rows.select("canonical_key", "id", "doi", "title", F.sha2("abstract", 256).alias("abstract_sha256"), F.array_join("authors", "|").alias("authors"), "citations", "journal", "year", "n_old", "n_hits", "decision", F.round("score", 4).alias("score"), "status")


@query("harvest_matches", f"""WITH {ROWS},
m AS (SELECT *, min((kind, id)) OVER (PARTITION BY doi) AS by_doi, min((kind, id)) OVER (PARTITION BY grp, key, year) AS by_title, min((kind, id)) OVER (PARTITION BY grp) AS by_grp,
  min((kind, id)) FILTER (doi IS NULL) OVER (PARTITION BY grp, key, year) AS bare FROM g)
SELECT id, grp AS canonical_key, CASE WHEN doi IS NOT NULL AND by_doi < (kind, id) THEN 'doi' WHEN doi IS NULL AND by_title < (kind, id) THEN 'title' WHEN doi IS NOT NULL AND bare < (kind, id) THEN 'provisional'
  WHEN by_grp < (kind, id) THEN 'chain' ELSE 'new' END AS matched_by FROM m WHERE kind = 1""")
def harvest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each hit of a harvest finds its record."""
    return hit_matches(*harvest(spark, sf_dir))
