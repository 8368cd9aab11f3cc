"""Metadata enrichment as a cascade: each tier is asked for what the tiers before left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import title_key
from lodestar.operators.entities import ALIKE, KEY, judged_titles, placed_grams, title_meetings
from lodestar.operators.selection import first_by
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, articles
from lodestar.sources.tables import stored

#: Fields that a tier's record can fill, and the confidence of each kind of match but that by likeness, which has its own.
FILLED = ["doi", "year", "journal", "authors"]
SURE = {"doi": 1.0, "id": 1.0, "twin": 1.0}


def missing(x: Column) -> Column:
    """Null, blank, or an empty list."""
    return x.isNull() | (F.trim(x.cast("string")).isin("", "[]"))


def like_titles(left: DataFrame, right: DataFrame, least: float = ALIKE) -> DataFrame:
    """``a, b, likeness``: all pairs of ``left(id, key)`` and ``right(id, key)`` that are ``least`` alike; the likeness is one less the edit distance over the longer length.

    Equal keys are joined, others meet by :func:`title_meetings`: no pair of one table is ever made.
    """
    left, right = stored(left, "left"), stored(right, "right")
    equal = left.select(F.col("id").alias("a"), "key").join(right.select(F.col("id").alias("b"), "key").hint("merge"), "key").select("a", "b", F.lit(1.0).alias("likeness"))
    met = title_meetings(stored(placed_grams(left, least), "grams"), stored(placed_grams(right, least), "grams"), least).distinct()
    return judged_titles(met, left, right, least).unionByName(equal)


def enriched(targets: DataFrame, tiers: list[tuple[str, str, DataFrame]], least: float = ALIKE) -> DataFrame:
    """Every row of ``targets(id, doi, provider_id, title, year, journal, authors)`` with its empty fields filled, and ``method, record_id, confidence, missing_before, missing_after``.

    ``tiers`` are ``(name, kind, records(record_id, doi, provider_id, title, year, journal, authors))`` in the order they are asked; a target goes to the first that has a match:

    * ``doi``, ``id``: the same DOI or provider's id; of several records the least.
    * ``twin``: the one record with the same title key, if there is exactly one, years at most one apart and an author shared, where both have any.
    * ``title``: the best of the records whose title keys are ``least`` alike, by acceptance (years and authors as for a twin), then likeness, then id. One that is not accepted fills nothing; it makes the method ``review`` if
      no later tier matches either.

    A title that is empty matches nothing. What a target has is never overwritten.
    """
    named = targets.withColumn("key", F.when(~missing(F.col("title")), title_key(F.col("title"))))
    left, found = stored(named, "targets"), []
    review = None
    far = lambda: F.abs(F.col("year") - F.col("_year")) > 1
    foreign = (F.size("authors") > 0) & (F.size("_authors") > 0) & ~F.arrays_overlap("authors", "_authors")
    for name, kind, records in tiers:
        own = records.select(F.col("record_id"), *(F.col(c).alias(f"_{c}") for c in FILLED), F.col("provider_id").alias("_pid"), F.when(~missing(F.col("title")), title_key(F.col("title"))).alias("_key"))
        fits = ~F.coalesce(far(), F.lit(False)) & ~F.coalesce(foreign, F.lit(False))
        if kind == "doi":
            met = left.join(own, F.lower(left["doi"]) == F.lower(own["_doi"])).withColumns({"ok": F.lit(True), "confidence": F.lit(SURE[kind])})
        elif kind == "id":
            met = left.join(own, left["provider_id"] == own["_pid"]).withColumns({"ok": F.lit(True), "confidence": F.lit(SURE[kind])})
        elif kind == "twin":
            single = own.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_key")
            met = left.join(own.join(single, "_key"), F.col("key") == F.col("_key")).where(fits).withColumns({"ok": F.lit(True), "confidence": F.lit(SURE[kind])})
        elif kind == "title":
            keys = lambda df, k: df.where(F.col(k).isNotNull()).select(F.xxhash64(k).alias("id"), F.col(k).alias("key")).distinct()
            alike = like_titles(keys(left, "key"), keys(own, "_key"), least)
            people = lambda c: F.array_sort(F.array_distinct(c))
            # rows of one title, year and authors are matched alike: each such group asks once, and its least record answers
            asking = left.where("key IS NOT NULL").select(F.xxhash64("key").alias("a"), F.col("year"), people("authors").alias("authors")).distinct()
            payload = ["record_id", *(f"_{c}" for c in FILLED)]
            answers = own.where("_key IS NOT NULL").groupBy(F.xxhash64("_key").alias("b"), "_year", people("_authors").alias("_people")).agg(F.min(F.struct(*payload)).alias("r")).select("b", "r.*")
            met = asking.join(alike.hint("merge"), "a").join(answers.hint("merge"), "b").withColumn("ok", fits)
            best = met.groupBy("a", "year", "authors").agg(F.min(F.struct((~F.col("ok")).alias("no"), (-F.round("likeness", 9)).alias("far"), *payload, F.col("likeness").alias("confidence"))).alias("x"))
            best = best.select("a", F.col("year").alias("y"), F.col("authors").alias("p"), (~F.col("x.no")).alias("ok"), *(F.col(f"x.{c}").alias(c) for c in [*payload, "confidence"]))
            met = left.withColumn("a", F.xxhash64("key")).join(best.hint("merge"), "a").where(F.col("year").eqNullSafe(F.col("y")) & people("authors").eqNullSafe(F.col("p")))
        else:
            raise ValueError(f"unknown kind of tier {kind}")
        best = stored(first_by(met, ["id"], [F.desc("ok"), F.desc(F.round("confidence", 9)), "record_id"]), "tier")
        found.append(best.where("ok").withColumn("method", F.lit(name)).select("id", "record_id", "confidence", "method", *(f"_{c}" for c in FILLED)))
        held = best.where("NOT ok").select("id", "record_id", "confidence")
        review = held if review is None else review.unionByName(held)
        left = stored(left.join(best.where("ok").select("id"), "id", "left_anti"), "left")
    matched = found[0]
    for part in found[1:]:
        matched = matched.unionByName(part)
    doubted = first_by(review, ["id"], [F.desc(F.round("confidence", 9)), "record_id"]).select("id", F.col("record_id").alias("_rid"), F.col("confidence").alias("_c"))
    full = targets.join(matched, "id", "left").join(doubted, "id", "left")
    method = F.coalesce("method", F.when(F.col("_rid").isNotNull(), "review").otherwise("none"))
    count = lambda cols: sum((missing(c).cast("int") for c in cols), F.lit(0))
    new = {c: F.when(missing(F.col(c)), F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in FILLED}
    return full.select(
        "id", "title", *(x.alias(c) for c, x in new.items()), method.alias("method"), F.coalesce("record_id", "_rid").alias("record_id"), F.coalesce("confidence", "_c").alias("confidence"),
        count([F.col(c) for c in FILLED]).alias("missing_before"), count(list(new.values())).alias("missing_after"),
    )


def gaps(rows: DataFrame) -> DataFrame:
    """``field, n``: how many of ``rows`` lack each field."""
    counts = rows.agg(*(F.count_if(missing(F.col(c))).alias(c) for c in FILLED))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in FILLED))).alias("x")).select("x.field", "x.n")


def bound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str, DataFrame]]]:
    """The stored articles with some of their fields gone and some titles misspelt, and five tiers of records that know parts of them."""
    i, rows = F.col("article_id"), articles(spark, sf_dir)
    authors = F.array("source")
    spelt = F.when(i % 3 == 0, F.concat("title", F.lit("s"))).otherwise(F.col("title"))
    pid = F.concat(F.lit("p"), i.cast("string"))
    targets = rows.select(i.alias("id"), F.when(i % 2 == 0, F.col("doi")).alias("doi"), F.when(i % 5 == 1, pid).alias("provider_id"), spelt.alias("title"), F.when(i % 7 != 0, F.col("year")).cast("int").alias("year"), F.lit(None).cast("string").alias("journal"), F.when(i % 4 == 0, authors).otherwise(F.array().cast("array<string>")).alias("authors"))
    records = rows.select(i.alias("record_id"), "doi", pid.alias("provider_id"), "title", "year", F.col("source").alias("journal"), authors.alias("authors"), "status", "lang")
    of = lambda where: records.where(where).drop("status", "lang")
    return targets, [("doi", "doi", of("status = 'indexed'")), ("id", "id", of("status = 'validated'")), ("twin", "twin", of("lang = 'en'")), ("title", "title", of("lang <> 'en'")), ("fallback", "title", of("status = 'rejected'"))]


def tier_sql(k: int, kind: str, where: str) -> str:
    record = f"r{k} AS (SELECT article_id AS rid, lower(doi) AS rdoi, doi AS rd, 'p' || article_id AS rpid, key AS rkey, year AS ry, source AS rs FROM a WHERE {where})"
    fits = "NOT coalesce(abs(year - ry) > 1, false) AND (authors IS NULL OR authors = rs)"
    if kind == "twin":
        met = f"SELECT t.id, rid, rd, ry, rs, true AS ok, 1.0 AS c FROM l{k} t JOIN r{k} ON t.key = rkey WHERE {fits} AND rkey IN (SELECT rkey FROM r{k} GROUP BY rkey HAVING count(*) = 1)"
    elif kind == "title":
        like = "1 - levenshtein(t.key, rkey) / greatest(length(t.key), length(rkey))"
        met = f"SELECT * FROM (SELECT t.id, rid, rd, ry, rs, {fits} AS ok, {like} AS c FROM l{k} t JOIN r{k} ON least(length(t.key), length(rkey)) >= 0.96 * greatest(length(t.key), length(rkey)) - 1e-9) WHERE c >= 0.96 - 1e-9"
    else:
        met = f"SELECT t.id, rid, rd, ry, rs, true AS ok, 1.0 AS c FROM l{k} t JOIN r{k} ON {'lower(t.doi) = rdoi' if kind == 'doi' else 't.pid = rpid'}"
    best = f"b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ok DESC, round(c, 9) DESC, rid) AS n FROM ({met})) WHERE n = 1)"
    return f"{record}, {best}, l{k + 1} AS (SELECT * FROM l{k} WHERE id NOT IN (SELECT id FROM b{k} WHERE ok))"


WHERE = [("doi", "doi", "status = 'indexed'"), ("id", "id", "status = 'validated'"), ("twin", "twin", "lang = 'en'"), ("title", "title", "lang <> 'en'"), ("fallback", "title", "status = 'rejected'")]


@query("enrichment_cascade", f"""WITH {ARTICLES}, a AS (SELECT *, CASE WHEN trim(title, ' ') <> '' THEN {KEY} END AS key FROM articles),
 s AS (SELECT article_id AS id, CASE WHEN article_id % 2 = 0 THEN doi END AS doi, CASE WHEN article_id % 5 = 1 THEN 'p' || article_id END AS pid, CASE WHEN article_id % 3 = 0 THEN title || 's' ELSE title END AS title, CASE WHEN article_id % 7 <> 0 THEN year END AS year, CASE WHEN article_id % 4 = 0 THEN source END AS authors FROM articles),
 l0 AS (SELECT *, CASE WHEN trim(title, ' ') <> '' THEN {KEY} END AS key FROM s), {', '.join(tier_sql(k, kind, where) for k, (_, kind, where) in enumerate(WHERE))},
 m AS ({' UNION ALL '.join(f"SELECT id, rid, rd, ry, rs, c, '{name}' AS method FROM b{k} WHERE ok" for k, (name, _, _) in enumerate(WHERE))}),
 d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, rid) AS n FROM ({' UNION ALL '.join(f'SELECT id, rid, c FROM b{k} WHERE NOT ok' for k in range(len(WHERE)))})) WHERE n = 1)
SELECT s.id, coalesce(s.doi, rd) AS doi, coalesce(s.year, ry) AS year, rs AS journal, coalesce(authors, rs) AS authors, coalesce(method, CASE WHEN d.id IS NOT NULL THEN 'review' ELSE 'none' END) AS method, coalesce(m.rid, d.rid) AS record_id, round(coalesce(m.c, d.c), 6) AS confidence,
 CAST(s.doi IS NULL AS INT) + CAST(s.year IS NULL AS INT) + 1 + CAST(authors IS NULL AS INT) AS missing_before, CAST(coalesce(s.doi, rd) IS NULL AS INT) + CAST(coalesce(s.year, ry) IS NULL AS INT) + CAST(rs IS NULL AS INT) + CAST(coalesce(authors, rs) IS NULL AS INT) AS missing_after
FROM s LEFT JOIN m ON m.id = s.id LEFT JOIN d ON d.id = s.id""")
def enrichment_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored articles, completed tier by tier."""
    rows = enriched(*bound(spark, sf_dir))
    return rows.drop("title").withColumns({"authors": F.get("authors", F.lit(0)), "confidence": F.round("confidence", 6)})
