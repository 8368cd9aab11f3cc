"""Evidence search: what a question asks for, how near a text comes to it, and the searches and merges that follow from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import title_key, tokens
from lodestar.operators.retrieval import (
    ARTICLE_RANK,
    CANDIDATES,
    CHUNK_FIELDS,
    LEXICAL_SQL,
    POSTINGS,
    VECTOR_OF,
    article_details,
    article_hits,
    best_lexical,
    lexical_candidates,
    nearest,
    ranked_articles,
    small,
    stand_in_vectors,
    top,
)
from lodestar.operators.selection import first_by
from lodestar.plans.registry import ORACLES, query
from lodestar.sources.bindings import CHUNKS, FOLD, TOKENS, VISIBLE, chunks, search_queries
from lodestar.sources.tables import stored, table

# Scores of the tiers of the asked-for matter, weights of the parts, factors of missing parts, weights of the merges.
TIERS = {"exact": 1.0, "near": 0.88, "distant": 0.28, "none": 0.0}
PARTS = {"matrix": 0.45, "process": 0.30, "outcome": 0.25}
TITLE_PARTS = {"matrix": 0.45, "process": 0.35, "outcome": 0.20}
TITLE_FLOOR, TITLE_SHARE, CAUSAL_BONUS = 0.82, 0.18, 0.02
NO_MATRIX, DISTANT_MATRIX, NO_PROCESS, NO_OUTCOME = 0.20, 0.55, 0.35, 0.45
RERANK_RELEVANCE, RERANK_SIGNAL, RERANK_DECAY = 0.90, 0.10, 0.08
MERGE_RELEVANCE, MERGE_SIGNAL, FULL_TEXT_BONUS, FULL_TEXT_LEAST = 0.90, 0.07, 0.03, 0.3
STRUCTURED_RELEVANCE, STRUCTURED_RANK = 0.85, 0.15
FINAL_RELEVANCE, FINAL_RANK, FINAL_PLACE = 0.80, 0.15, 0.05
ABSTRACT_LEXICAL, ABSTRACT_VECTOR, THEME_BONUS, RRF_K = 0.4, 0.6, 0.02, 60
RECORD_FIELDS = {"title": 2.0, "abstract": 1.0}
#: Added before a result is rounded, so that sums that differ in their last bits round alike.
TIE = 1e-10
#: Kinds of phrases in a lexicon of intents: tiers of the matter, processes, facets of the outcome, and what excludes a text.
KINDS = ("primary", "close", "distant", "process", "facet", "exclusion")
GRADES = ("A", "B", "C", "D", "unassessed")
FOLDED_TITLE = FOLD.format(x="title")


def padded(words: Column) -> Column:
    """Words between blanks, so that a phrase can be sought whole."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def says(text: Column, phrase: Column) -> Column:
    return F.contains(text, F.concat(F.lit(" "), phrase, F.lit(" ")))


def says_any(text: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: says(text, p))


# --- intents -------------------------------------------------------------------------------------


def intents(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``query_id``, an array of phrases for every kind but facets, and ``facets(facet, terms)``, of ``queries(query_id, query)``.

    ``lexicon(kind, facet, phrase)`` holds folded phrases; a query has those that stand in it whole. Phrases meet queries by their first word.
    """
    said = queries.select("query_id", tokens(F.col("query")).alias("w")).select("query_id", padded(F.col("w")).alias("said"), F.explode(F.array_distinct("w")).alias("first"))
    met = said.join(lexicon.withColumn("first", F.split_part("phrase", F.lit(" "), F.lit(1))), "first").where(says(F.col("said"), F.col("phrase")))
    kinds = met.groupBy("query_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("phrase")))).alias(k) for k in KINDS if k != "facet"])
    facets = met.where("kind = 'facet'").groupBy("query_id", "facet").agg(F.array_sort(F.collect_set("phrase")).alias("terms"))
    facets = facets.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("facet", "terms"))).alias("facets"))
    full = queries.select("query_id").join(kinds, "query_id", "left").join(facets, "query_id", "left")
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<struct<facet string, terms array<string>>>")
    return full.select("query_id", *[F.coalesce(k, empty).alias(k) for k in KINDS if k != "facet"], F.coalesce("facets", none).alias("facets"))


def derived_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon for the stored tables: the queries' words of four letters or more, the kind by the first letter, which is also the facet."""
    words = search_queries(spark, sf_dir).select(F.explode(tokens(F.col("query"))).alias("phrase")).where(F.length("phrase") >= 4).distinct()
    kinds = F.array(*map(F.lit, (*KINDS, "facet")))
    return words.select(F.element_at(kinds, (F.ascii("phrase") % 7 + 1).cast("int")).alias("kind"), F.substring("phrase", 1, 1).alias("facet"), "phrase")


def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents(search_queries(spark, sf_dir), derived_lexicon(spark, sf_dir))


QUERY_WORDS = f"qw AS (SELECT item_id AS query_id, {TOKENS.format(x='text')} AS w FROM benchmark)"
INTENTS = (
    QUERY_WORDS
    + """, lexicon AS (SELECT (['primary','close','distant','process','facet','exclusion','facet'])[ascii(phrase) % 7 + 1] AS kind, phrase[1:1] AS facet, phrase FROM (SELECT DISTINCT unnest(w) AS phrase FROM qw) WHERE length(phrase) >= 4),
 met AS (SELECT query_id, kind, facet, phrase FROM (SELECT query_id, unnest(list_distinct(w)) AS phrase FROM qw) JOIN lexicon USING (phrase)),
 fct AS (SELECT query_id, list({'facet': facet, 'terms': terms} ORDER BY facet) AS facets FROM (SELECT query_id, facet, list(phrase ORDER BY phrase) AS terms FROM met WHERE kind = 'facet' GROUP BY ALL) GROUP BY query_id),
 intents AS (SELECT qw.query_id, """
    + ", ".join(f"coalesce((SELECT list(phrase ORDER BY phrase) FROM met m WHERE m.query_id = qw.query_id AND kind = '{k}'), []::VARCHAR[]) AS {k}" for k in KINDS if k != "facet")
    + ", coalesce(facets, []) AS facets FROM qw LEFT JOIN fct USING (query_id))"
)


@query("scientific_intents", f"WITH {INTENTS} SELECT query_id, array_to_string(\"primary\", ' ') AS matter, array_to_string(close, ' ') AS close, array_to_string(process, ' ') AS process, len(facets) AS facets FROM intents")
def scientific_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every query asks for, by the lexicon."""
    i = query_intents(spark, sf_dir)
    return i.select("query_id", F.array_join("primary", " ").alias("matter"), F.array_join("close", " ").alias("close"), F.array_join("process", " ").alias("process"), F.size("facets").cast("long").alias("facets"))


# --- relevance -----------------------------------------------------------------------------------


def judged(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows(query_id, title, text, ...)`` with ``tier, process_score, outcome, matched, causal, relevance, grade`` by the intents ``asked``.

    The title's tier of the asked-for matter goes before the text's. Parts that nobody asked for count as met. Missing ones
    scale the score down; a title that names the parts scales it up. The grade says how directly a text bears on the question,
    whatever its score; an excluded word in the title makes it D.
    """
    t, b = padded(tokens(F.coalesce("title", F.lit("")))), padded(tokens(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_t", t).withColumn("_b", b).join(asked, "query_id").withColumn("_all", F.concat("_t", "_b"))
    in_title = {tier: says_any(F.col("_t"), F.col(k)) for tier, k in (("exact", "primary"), ("near", "close"), ("distant", "distant"))}
    in_text = {tier: says_any(F.col("_b"), F.col(k)) for tier, k in (("exact", "primary"), ("near", "close"), ("distant", "distant"))}
    tier = F.lit("none")
    for found in (in_text, in_title):
        for name in ("distant", "near", "exact"):
            tier = F.when(found[name], name).otherwise(tier)
    rows = rows.withColumn("tier", tier)
    n = F.size("facets")
    met = lambda text: F.filter("facets", lambda f: says_any(text, f["terms"]))
    rows = rows.withColumn("matched", F.transform(met(F.col("_all")), lambda f: f["facet"]))
    process_asked = F.size("process") > 0
    rows = rows.withColumn("process_score", F.when(~process_asked | says_any(F.col("_all"), F.col("process")), 1.0).otherwise(0.0))
    rows = rows.withColumn("outcome", F.when(n == 0, 1.0).otherwise(F.size("matched") / n))
    matrix = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("tier")]
    title = (
        TITLE_PARTS["matrix"] * (in_title["exact"] | in_title["near"] | in_title["distant"]).cast("double")
        + TITLE_PARTS["process"] * (~process_asked | says_any(F.col("_t"), F.col("process"))).cast("double")
        + TITLE_PARTS["outcome"] * F.when(n == 0, 1.0).otherwise(F.size(met(F.col("_t"))) / n)
    )
    rows = rows.withColumn("_matrix", matrix).withColumn("_title", title)
    p, o, m = F.col("process_score"), F.col("outcome"), F.col("_matrix")
    rows = rows.withColumn("causal", (m >= 0.8) & (p > 0) & (o > 0))
    score = (PARTS["matrix"] * m + PARTS["process"] * p + PARTS["outcome"] * o) * (TITLE_FLOOR + TITLE_SHARE * F.col("_title")) + F.when(F.col("causal"), CAUSAL_BONUS).otherwise(0.0)
    score = score * F.when((F.size("primary") > 0) & (m == 0), NO_MATRIX).when(F.col("tier") == "distant", DISTANT_MATRIX).otherwise(1.0)
    score = score * F.when(process_asked & (p == 0), NO_PROCESS).otherwise(1.0) * F.when((n > 0) & (o == 0), NO_OUTCOME).otherwise(1.0)
    rows = rows.withColumn("relevance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    matter_asked = (F.size("primary") > 0) | (F.size("close") > 0)
    direct = ~matter_asked | (F.col("tier") == "exact")
    applicable = ~matter_asked | F.col("tier").isin("exact", "near")
    structured = (F.size("primary") > 0) | process_asked | (n > 0)
    grade = (
        F.when(~structured, "unassessed").when(says_any(F.col("_t"), F.col("exclusion")), "D").when(direct & (p > 0) & (o > 0), "A")
        .when(process_asked & (p == 0), F.when((F.col("tier") == "distant") | (o > 0), "C").otherwise("D"))
        .when(applicable & ((p > 0) | (o > 0)), "B").when((F.col("tier") == "distant") | (p > 0) | (o > 0), "C").otherwise("D")
    )
    return rows.withColumn("grade", grade).withColumn("_structured", structured).drop("_t", "_b", "_all", "_matrix", "_title")


def says_sql(text: str, phrases: str) -> str:
    return f"len(list_filter({phrases}, lambda p: contains({text}, ' ' || p || ' '))) > 0"


def judged_sql(source: str, out: str) -> str:
    """CTEs that judge ``source(query_id, rid, title, text, ...)`` as ``out``."""
    t, b = (f"' ' || array_to_string({TOKENS.format(x=f"coalesce({c}, '')")}, ' ') || ' '" for c in ("title", "text"))
    both, n = "concat(tt, bb)", "len(facets)"
    tier = " ".join(f"WHEN {says_sql(x, k)} THEN '{name}'" for x in ("tt", "bb") for name, k in (("exact", '"primary"'), ("near", "close"), ("distant", "distant")))
    met = lambda x: f"list_filter(facets, lambda f: len(list_filter(f.terms, lambda p: contains({x}, ' ' || p || ' '))) > 0)"
    title_any = " OR ".join(says_sql("tt", k) for k in ('"primary"', "close", "distant"))
    return f"""{out}0 AS (SELECT s.*, i.* EXCLUDE (query_id), {t} AS tt, {b} AS bb FROM {source} s JOIN intents i ON i.query_id = s.query_id),
 {out}1 AS (SELECT *, CASE {tier} ELSE 'none' END AS tier, list_transform({met(both)}, lambda f: f.facet) AS matched, CASE WHEN len(process) = 0 OR {says_sql(both, 'process')} THEN 1.0 ELSE 0.0 END AS p,
  0.45 * CASE WHEN {title_any} THEN 1.0 ELSE 0.0 END + 0.35 * CASE WHEN len(process) = 0 OR {says_sql('tt', 'process')} THEN 1.0 ELSE 0.0 END + 0.20 * CASE WHEN {n} = 0 THEN 1.0 ELSE len({met('tt')}) / {n} END AS ti,
  {says_sql('tt', 'exclusion')} AS excluded FROM {out}0),
 {out}2 AS (SELECT *, CASE tier WHEN 'exact' THEN 1.0 WHEN 'near' THEN 0.88 WHEN 'distant' THEN 0.28 ELSE 0.0 END AS m, CASE WHEN {n} = 0 THEN 1.0 ELSE len(matched) / {n} END AS o FROM {out}1),
 {out} AS (SELECT *, m >= 0.8 AND p > 0 AND o > 0 AS causal, len("primary") > 0 OR len(process) > 0 OR {n} > 0 AS structured,
  CAST(least(1, greatest(0, ((0.45 * m + 0.30 * p + 0.25 * o) * (0.82 + 0.18 * ti) + CASE WHEN m >= 0.8 AND p > 0 AND o > 0 THEN 0.02 ELSE 0 END) * CASE WHEN len("primary") > 0 AND m = 0 THEN 0.20 WHEN tier = 'distant' THEN 0.55 ELSE 1 END
   * CASE WHEN len(process) > 0 AND p = 0 THEN 0.35 ELSE 1 END * CASE WHEN {n} > 0 AND o = 0 THEN 0.45 ELSE 1 END)) AS DOUBLE) AS relevance,
  CASE WHEN NOT (len("primary") > 0 OR len(process) > 0 OR {n} > 0) THEN 'unassessed' WHEN excluded THEN 'D' WHEN (len("primary") + len(close) = 0 OR tier = 'exact') AND p > 0 AND o > 0 THEN 'A'
   WHEN len(process) > 0 AND p = 0 THEN CASE WHEN tier = 'distant' OR o > 0 THEN 'C' ELSE 'D' END WHEN (len("primary") + len(close) = 0 OR tier IN ('exact', 'near')) AND (p > 0 OR o > 0) THEN 'B' WHEN tier = 'distant' OR p > 0 OR o > 0 THEN 'C' ELSE 'D' END AS grade FROM {out}2)"""


def place_in(order, x: str) -> Column:
    """The place of a column's value in a fixed order."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(x))


GRADE_SQL = "list_position(['A','B','C','D','unassessed'], grade)"
TIER_SQL = "list_position(['exact','near','distant','none'], tier)"

PAIRS = "pairs AS (SELECT query_id, doc_id AS rid, split_part(d.text, chr(10), 1) AS title, d.text AS text FROM cand JOIN documents d ON doc_id = article_id)"


@query("scientific_relevance", f"{CANDIDATES}, {INTENTS}, {PAIRS}, {judged_sql('pairs', 'j')} SELECT query_id, rid AS article_id, tier, round(relevance + 1e-10, 6) AS score, grade, len(matched) AS facets FROM j")
def scientific_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each query's best chunks against what the query asks for."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")
    rows = docs.join(lexical_candidates(spark, sf_dir), "article_id")
    return judged(rows, query_intents(spark, sf_dir)).select("query_id", "article_id", "tier", F.round(F.col("relevance") + TIE, 6).alias("score"), "grade", F.size("matched").cast("long").alias("facets"))


# --- searches ------------------------------------------------------------------------------------


def reranked(records: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of ``records(query_id, rid, title, text, doi, full, rank)`` by grade, causality, tier and relevance with a little of the first rank.

    Records with one DOI, or one title where there is none, are one; one with the full text goes before, then the first. Queries that ask for nothing
    in particular keep the first ranks.
    """
    key = F.coalesce(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("title:"), title_key(F.col("title"))))
    own = first_by(records.withColumn("_key", key), ["query_id", "_key"], [F.desc("full"), "rank", "rid"])
    own = judged(own, asked)
    combined = F.least(F.lit(1.0), RERANK_RELEVANCE * F.col("relevance") + RERANK_SIGNAL / (1 + RERANK_DECAY * (F.col("rank") - 1)))
    own = own.withColumn("combined", F.round(combined, 9)).withColumn("_first", F.col("rank"))
    told = lambda c: F.when(F.col("_structured"), c).otherwise(0)
    order = [told(place_in(GRADES, "grade")), told((~F.col("causal")).cast("int")), told(place_in(TIERS, "tier")), told(-F.col("combined")), "_first", "rid"]
    return top(own.drop("rank"), ["query_id"], order, most)


RERANKED_ORDER = f"CASE WHEN structured THEN {GRADE_SQL} ELSE 0 END, CASE WHEN structured AND NOT causal THEN 1 ELSE 0 END, CASE WHEN structured THEN {TIER_SQL} ELSE 0 END, CASE WHEN structured THEN -combined ELSE 0 END, rank, rid"


def reranked_sql(source: str, out: str) -> str:
    key = f"coalesce('doi:' || lower(doi), 'title:' || CASE WHEN regexp_replace({FOLDED_TITLE}, '[^a-z0-9]+', '', 'g') = '' THEN sha256(title) ELSE regexp_replace({FOLDED_TITLE}, '[^a-z0-9]+', '', 'g') END)"
    return f"""{out}k AS (SELECT *, row_number() OVER (PARTITION BY query_id, {key} ORDER BY "full" DESC, rank, rid) AS kn FROM {source}), {out}u AS (SELECT * FROM {out}k WHERE kn = 1),
 {judged_sql(out + 'u', out + 'j')}, {out}c AS (SELECT *, round(least(1, 0.90 * relevance + 0.10 / (1 + 0.08 * (rank - 1))), 9) AS combined FROM {out}j),
 {out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {RERANKED_ORDER}) AS place FROM {out}c)"""


def abstract_lists(records: DataFrame, queries: DataFrame, themes: DataFrame, most: int) -> DataFrame:
    """``query_id, rid, rank`` of the ``most`` best of ``records(rid, title, abstract, theme)``: a lexical and a vector list, fused, and a bonus for one of the query's ``themes(query_id, theme)``."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    candidates = min(max(5 * most, 50), 200)
    lexical = best_lexical(records, "rid", RECORD_FIELDS, asked, candidates).select("query_id", "rid", F.col("rank").alias("lexical"))
    vectors = stand_in_vectors(records.withColumn("_text", F.concat_ws(" ", "title", "abstract")), "rid", "_text").withColumnRenamed("rid", "id")
    near = nearest(vectors, stand_in_vectors(queries, "query_id", "query"), candidates).select("query_id", F.col("id").alias("rid"), F.col("rank").alias("vector"))
    both = lexical.join(near, ["query_id", "rid"], "full").join(records.select("rid", "theme"), "rid")
    both = both.join(themes.select("query_id", "theme", F.lit(THEME_BONUS).alias("_bonus")).distinct(), ["query_id", "theme"], "left")
    part = lambda w, c: F.coalesce(w / (RRF_K + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", F.round(part(ABSTRACT_LEXICAL, "lexical") + part(ABSTRACT_VECTOR, "vector") + F.coalesce("_bonus", F.lit(0.0)), 12))
    far = F.lit(10**9)
    return top(both, ["query_id"], [F.desc("score"), F.coalesce("lexical", far), F.coalesce("vector", far), "rid"], most).select("query_id", "rid", "rank")


def abstract_search(articles: DataFrame, queries: DataFrame, themes: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """The ``most`` best records of each query among ``articles(article_id, title, abstract, doi, full, theme)``, reranked.

    Articles with full text come by their titles (equal to the query but for folding), then by their lexical rank; abstracts alone by
    lexical and vector rank. An abstract needs a DOI, and goes if an article with full text has it.
    """
    own = articles.withColumnRenamed("article_id", "rid")
    full, bare = own.where("full"), own.where("NOT full AND doi IS NOT NULL AND abstract IS NOT NULL")
    pool = min(max(2 * most, 30), 100)
    titled = full.select("rid", title_key(F.col("title")).alias("k")).join(queries.select("query_id", title_key(F.col("query")).alias("k")), "k").select("query_id", "rid", F.lit(0).alias("kind"), F.lit(1.0).alias("score"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    lexical = best_lexical(full, "rid", RECORD_FIELDS, terms, pool)
    lexical = lexical.select("query_id", "rid", F.lit(1).alias("kind"), (1 / (RRF_K + F.col("rank"))).alias("score"))
    found = first_by(titled.unionByName(lexical), ["query_id", "rid"], ["kind"])
    found = top(found, ["query_id"], ["kind", F.desc("score"), "rid"], pool).select("query_id", "rid", "rank")
    held = full.where("doi IS NOT NULL").select("doi").distinct()
    loose = abstract_lists(bare.join(held, "doi", "left_anti"), queries, themes, pool)
    both = found.unionByName(loose).join(own.select("rid", "title", F.coalesce("abstract", F.lit("")).alias("text"), "doi", "full"), "rid")
    return reranked(both, asked, most)


def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles as records: the visible ones have full text, the source is the theme."""
    own = article_details(spark, sf_dir).withColumn("full", F.col("status").isin(VISIBLE))
    return own.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("theme")), "article_id").drop("status")


def query_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries(spark, sf_dir).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("theme"))


def abstract_results(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    return abstract_search(search_records(spark, sf_dir), search_queries(spark, sf_dir), query_themes(spark, sf_dir), query_intents(spark, sf_dir), most)


RECORD_LISTS = """recs AS (SELECT d.doc_id AS rid, split_part(d.text, chr(10), 1) AS title, CASE WHEN trim(split_part(d.text, chr(10), 2), ' ') <> '' THEN split_part(d.text, chr(10), 2) END AS abstract, CASE WHEN d.doc_id % 3 <> 0 THEN '10.5555/ls.' || CAST(d.doc_id // 2 AS VARCHAR) END AS doi, d.doc_id % 5 < 2 AS "full", source AS theme FROM documents d),
 rt AS (SELECT query_id, unnest(list_distinct(w)) AS term FROM qw),
 fulls AS (SELECT * FROM recs WHERE "full"), bares AS (SELECT * FROM recs WHERE NOT "full" AND doi IS NOT NULL AND abstract IS NOT NULL AND doi NOT IN (SELECT doi FROM fulls WHERE doi IS NOT NULL))"""


def record_bm25(source: str, out: str) -> str:
    words = f"{out}w AS (SELECT rid, {TOKENS.format(x='title')} AS a, coalesce({TOKENS.format(x='abstract')}, []) AS b FROM {source})"
    return f"""{words}, {out}i AS (SELECT rid, len(a) + len(b) AS l, term, sum(w) AS tf FROM (SELECT rid, a, b, unnest(list_concat(a, b)) AS term, unnest(list_concat(list_transform(a, lambda x: 2.0), list_transform(b, lambda x: 1.0))) AS w FROM {out}w) GROUP BY ALL),
 {out}t AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS mean FROM {out}w), {out}d AS (SELECT term, count(*) AS df FROM {out}i GROUP BY term),
 {out}s AS (SELECT query_id, rid, CAST(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS DOUBLE) AS score FROM {out}i JOIN rt USING (term) JOIN {out}d USING (term), {out}t GROUP BY query_id, rid),
 {out}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, rid) AS rank FROM {out}s)"""


def title_key_sql(x: str) -> str:
    plain = f"regexp_replace({FOLD.format(x=x)}, '[^a-z0-9]+', '', 'g')"
    return f"CASE WHEN {plain} = '' THEN sha256({x}) ELSE {plain} END"


ABSTRACTS = f"""{RECORD_LISTS}, {record_bm25('fulls', 'fl')}, {record_bm25('bares', 'bl')},
 tl AS (SELECT item_id AS query_id, rid, 0 AS kind, CAST(1 AS DOUBLE) AS score FROM fulls JOIN benchmark b ON {title_key_sql('title')} = {title_key_sql('b.text')} UNION ALL SELECT query_id, rid, 1, 1 / (60 + rank) FROM flr WHERE rank <= 30),
 tf AS (SELECT query_id, rid, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rid ORDER BY kind) AS n FROM tl) WHERE n = 1), fx0 AS (SELECT query_id, rid, row_number() OVER (PARTITION BY query_id ORDER BY kind, score DESC, rid) AS rank FROM tf),
 bv AS (SELECT rid, {{vector_record}} AS v FROM bares), qv2 AS (SELECT item_id AS query_id, {{vector_query}} AS v FROM benchmark),
 bs AS (SELECT query_id, rid, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN list_sum(bv.v) = 0 OR list_sum(qv2.v) = 0 THEN 0 ELSE list_cosine_similarity(bv.v, qv2.v) END, 9) DESC, rid) AS rank FROM bv, qv2),
 bf AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.rid, v.rid) AS rid, l.rank AS lexical, v.rank AS vector FROM (SELECT * FROM blr WHERE rank <= 150) l FULL JOIN (SELECT * FROM bs WHERE rank <= 150) v ON l.query_id = v.query_id AND l.rid = v.rid),
 bo AS (SELECT query_id, rid, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(0.4 / (60 + lexical), 0) + coalesce(0.6 / (60 + vector), 0) + CASE WHEN theme = 'src' || CAST(query_id % 20 AS VARCHAR) THEN 0.02 ELSE 0 END, 12) DESC, coalesce(lexical, 1000000000), coalesce(vector, 1000000000), rid) AS rank FROM bf JOIN recs USING (rid)),
 both0 AS (SELECT u.query_id, u.rid, u.rank, title, coalesce(abstract, '') AS text, doi, "full" FROM (SELECT * FROM fx0 WHERE rank <= 30 UNION ALL SELECT * FROM bo WHERE rank <= 30) u JOIN recs USING (rid)), {reranked_sql('both0', 'ab')}"""
ABSTRACTS = ABSTRACTS.replace("{vector_record}", VECTOR_OF.format(x="concat_ws(' ', title, abstract)")).replace("{vector_query}", VECTOR_OF.format(x="text"))


@query("abstract_search", f"WITH {INTENTS}, {ABSTRACTS} SELECT query_id, rid AS article_id, place AS rank, grade, tier, round(combined + 1e-10, 6) AS score FROM ab WHERE place <= 12")
def abstract_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best records of each query, with grade and tier."""
    return abstract_results(spark, sf_dir, 12).select("query_id", F.col("rid").alias("article_id"), "rank", "grade", "tier", F.round(F.col("combined") + TIE, 6).alias("score"))


def full_text_search(hits: DataFrame, details: DataFrame, queries: DataFrame, texts: DataFrame, asked: DataFrame, axes: DataFrame, most: int) -> DataFrame:
    """The ``most`` best articles of each query for an answer: ranked articles and those of the axes' own ``axes(query_id, axis, article_id, chunk_id, rank)``, first occurrence first, scored by relevance and rank.

    The best of each axis is taken first, then the best of all; ``axes`` lists those that an article is in. Without a model that
    reads pairs of texts, an article's place in the order of the first score stands in for its verdict.
    """
    ranked = ranked_articles(hits, details, queries, texts, 40)
    pool = ranked.select("query_id", "article_id", F.col("best_chunk").alias("chunk_id"), "score", F.lit("").alias("axis"), F.lit(0).alias("turn"), "rank")
    pool = pool.unionByName(axes.select("query_id", "article_id", "chunk_id", F.lit(0.0).alias("score"), "axis", F.lit(1).alias("turn"), "rank"))
    merged = pool.groupBy("query_id", "article_id").agg(F.min_by("chunk_id", F.struct("turn", "rank", "axis")).alias("chunk_id"), F.max("score").alias("adjusted"), F.array_sort(F.collect_set(F.when(F.col("axis") != "", F.col("axis")))).alias("axes"))
    merged = stored(merged, "merged")
    # only the articles of the pool are cut into chunks
    its = small(merged.select("article_id").distinct(), merged.count())
    texts, details = texts.join(its, "article_id", "left_semi"), details.join(its, "article_id", "left_semi")
    full = merged.join(texts.select("chunk_id", F.col("text").alias("_chunk")), "chunk_id").join(details.select("article_id", "title", "abstract"), "article_id")
    full = judged(full.withColumn("text", F.concat_ws(" ", "abstract", "_chunk")), asked)
    first = F.round(F.least(F.lit(1.0), STRUCTURED_RELEVANCE * F.col("relevance") + STRUCTURED_RANK * F.col("adjusted")), 9)
    placed = full.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(first), "article_id")))
    final = F.round(F.least(F.lit(1.0), FINAL_RELEVANCE * F.col("relevance") + FINAL_RANK * F.col("adjusted") + FINAL_PLACE / F.col("_n")), 9)
    placed = stored(placed.withColumn("score", final), "placed")
    best = placed.select("query_id", "article_id", "score", F.explode("axes").alias("axis"))
    best = first_by(best, ["query_id", "axis"], [F.desc("score"), "article_id"]).groupBy("query_id", "article_id").agg(F.lit(True).alias("_quota"))
    placed = placed.join(best, ["query_id", "article_id"], "left")
    return top(placed, ["query_id"], [F.coalesce("_quota", F.lit(False)).desc(), F.desc("score"), "article_id"], most)


def axis_pools(spark: SparkSession, sf_dir: str, asked: DataFrame, most: int) -> DataFrame:
    """``query_id, axis, article_id, chunk_id, rank``: for each facet of a query the articles of the best chunks by its words, the process and the matter."""
    terms = asked.select("query_id", F.explode("facets").alias("f"), F.slice("primary", 1, 2).alias("p"), F.slice("close", 1, 5).alias("c"), F.slice("process", 1, 7).alias("x"))
    terms = terms.select(F.concat_ws("|", F.col("query_id").cast("string"), "f.facet").alias("axis_id"), F.explode(F.array_distinct(F.concat("p", "c", "x", F.slice("f.terms", 1, 8)))).alias("term"))
    best = best_lexical(chunks(spark, sf_dir), "chunk_id", {"text": 1.0}, terms.withColumnRenamed("axis_id", "query_id"), most)
    best = best.select(F.split_part("query_id", F.lit("|"), F.lit(1)).cast("long").alias("query_id"), F.split_part("query_id", F.lit("|"), F.lit(2)).alias("axis"), F.floor(F.col("chunk_id") / 100000).cast("long").alias("article_id"), "chunk_id", "rank")
    return first_by(best, ["query_id", "axis", "article_id"], ["rank"])


def full_text_results(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    asked = stored(query_intents(spark, sf_dir), "intents")
    return full_text_search(stored(article_hits(spark, sf_dir), "hits"), article_details(spark, sf_dir), search_queries(spark, sf_dir), chunks(spark, sf_dir), asked, axis_pools(spark, sf_dir, asked, 20), most)


FULL_TEXTS = f"""axt AS (SELECT query_id, f.facet AS axis, unnest(list_distinct(list_concat("primary"[1:2], close[1:5], process[1:7], f.terms[1:8]))) AS term FROM (SELECT query_id, "primary", close, process, unnest(facets) AS f FROM intents)),
 aw AS (SELECT chunk_id, article_id, {TOKENS.format(x='text')} AS w FROM chunks), ai AS (SELECT chunk_id, article_id, l, term, count(*) AS tf FROM (SELECT chunk_id, article_id, len(w) AS l, unnest(w) AS term FROM aw) GROUP BY ALL), ast AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM aw), adf AS (SELECT term, count(*) AS df FROM ai GROUP BY term),
 asc0 AS (SELECT query_id, axis, chunk_id, article_id, CAST(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS DOUBLE) AS score FROM ai JOIN axt USING (term) JOIN adf USING (term), ast GROUP BY query_id, axis, chunk_id, article_id),
 asr AS (SELECT *, row_number() OVER (PARTITION BY query_id, axis ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM asc0), axp AS (SELECT query_id, axis, article_id, arg_min(chunk_id, rank) AS chunk_id, min(rank) AS rank FROM asr WHERE rank <= 20 GROUP BY query_id, axis, article_id),
 pool AS (SELECT query_id, article_id, best_chunk AS chunk_id, score, '' AS axis, 0 AS turn, rank FROM ar WHERE rank <= 40 UNION ALL SELECT query_id, article_id, chunk_id, CAST(0 AS DOUBLE), axis, 1, rank FROM axp),
 mg AS (SELECT query_id, article_id AS rid, arg_min(chunk_id, (turn, rank, axis)) AS chunk_id, max(score) AS adjusted, list(DISTINCT axis ORDER BY axis) FILTER (axis <> '') AS axes FROM pool GROUP BY query_id, article_id),
 mt AS (SELECT mg.*, split_part(d.text, chr(10), 1) AS title, concat_ws(' ', CASE WHEN trim(split_part(d.text, chr(10), 2), ' ') <> '' THEN split_part(d.text, chr(10), 2) END, c.text) AS text FROM mg JOIN chunks c ON c.chunk_id = mg.chunk_id JOIN documents d ON d.doc_id = mg.rid), {judged_sql('mt', 'fj')},
 fo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(least(1, 0.85 * relevance + 0.15 * adjusted), 9) DESC, rid) AS nn FROM fj), fs AS (SELECT *, round(least(1, 0.80 * relevance + 0.15 * adjusted + 0.05 / nn), 9) AS score FROM fo),
 fq AS (SELECT DISTINCT query_id, rid FROM (SELECT query_id, rid, row_number() OVER (PARTITION BY query_id, axis ORDER BY score DESC, rid) AS k FROM (SELECT query_id, rid, score, unnest(axes) AS axis FROM fs)) WHERE k = 1),
 ft AS (SELECT fs.*, row_number() OVER (PARTITION BY fs.query_id ORDER BY CASE WHEN fq.rid IS NULL THEN 1 ELSE 0 END, score DESC, fs.rid) AS rank FROM fs LEFT JOIN fq ON fq.query_id = fs.query_id AND fq.rid = fs.rid)"""


@query("full_text_search", f"{LEXICAL_SQL}{ARTICLE_RANK}, {INTENTS}, {FULL_TEXTS} SELECT query_id, rid AS article_id, rank, chunk_id, round(score + 1e-10, 6) AS score, grade, coalesce(array_to_string(axes, ','), '') AS axes FROM ft WHERE rank <= 8")
def full_text_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best articles of each query, with the axes that they are in."""
    return full_text_results(spark, sf_dir, 8).select("query_id", "article_id", "rank", "chunk_id", F.round(F.col("score") + TIE, 6).alias("score"), "grade", F.array_join("axes", ",").alias("axes"))


def merged_evidence(records: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """``query_id, rid, place, grade, score`` of the ``most`` records for an answer from ``records(query_id, rid, title, text, doi, full, score)``.

    A record's score is its relevance with a little of the search's score, and a bonus for a relevant full text. Of records with one DOI or title the better one
    stays, the full text at equal scores. In the order of grade, score and tier, each facet in turn takes the first record that has it and is not taken; the rest follow.
    """
    own = judged(records, asked)
    bonus = F.when(F.col("full") & (F.col("relevance") >= FULL_TEXT_LEAST), FULL_TEXT_BONUS).otherwise(0.0)
    signal = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    own = own.withColumn("score", F.round(F.least(F.lit(1.0), MERGE_RELEVANCE * F.col("relevance") + MERGE_SIGNAL * signal + bonus), 9))
    key = F.coalesce(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("title:"), F.lower(F.regexp_replace(F.trim("title"), r"\s+", " "))))
    own = first_by(own.withColumn("_key", key), ["query_id", "_key"], [F.desc("score"), F.desc("full"), "rid"])
    order = Window.partitionBy("query_id").orderBy(place_in(GRADES, "grade"), F.desc("score"), place_in(TIERS, "tier"), F.desc(F.size("matched")), F.desc("full"), "rid")
    own = own.withColumn("_n", F.row_number().over(order))
    lists = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_n", "matched"))).alias("l"), F.first("facets").alias("facets"))
    free = lambda taken, f: F.filter("l", lambda r: F.array_contains(r["matched"], f["facet"]) & ~F.array_contains(taken, r["_n"]))
    taken = F.aggregate("facets", F.array().cast("array<int>"), lambda taken, f: F.concat(taken, F.slice(F.transform(free(taken, f), lambda r: r["_n"]), 1, 1)))
    first = lists.select("query_id", F.posexplode(taken).alias("_cover", "_n"))
    placed = own.join(first, ["query_id", "_n"], "left").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("_cover", F.lit(1 << 30)), "_n")))
    return placed.where(F.col("place") <= most)


MERGED = f"""me0 AS (SELECT ft.query_id, ft.rid, ft.title, ft.text, ft.score, CASE WHEN ft.rid % 3 <> 0 THEN '10.5555/ls.' || CAST(ft.rid // 2 AS VARCHAR) END AS doi, true AS "full" FROM ft WHERE ft.rank <= 8 UNION ALL SELECT query_id, rid, title, text, combined, doi, false FROM ab WHERE place <= 12), {judged_sql('me0', 'mj')},
 ms AS (SELECT * EXCLUDE (score), round(least(1, 0.90 * relevance + 0.07 * least(1, greatest(0, score)) + CASE WHEN "full" AND relevance >= 0.3 THEN 0.03 ELSE 0 END), 9) AS score FROM mj),
 mu AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce('doi:' || lower(doi), 'title:' || lower(regexp_replace(trim(title, ' '), '\\s+', ' ', 'g'))) ORDER BY score DESC, "full" DESC, rid) AS k FROM ms),
 mo AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {GRADE_SQL}, score DESC, {TIER_SQL}, len(matched) DESC, "full" DESC, rid) AS INTEGER) AS nn FROM mu WHERE k = 1),
 ml AS (SELECT query_id, list({{'n': nn, 'm': matched}} ORDER BY nn) AS l, any_value(facets) AS facets FROM mo GROUP BY query_id)"""
# each facet in turn takes the first record that has it and is not taken
COVERED = """cover AS (SELECT query_id, l, facets, 1 AS turn, []::INTEGER[] AS taken FROM ml UNION ALL SELECT query_id, l, facets, turn + 1, list_concat(taken, list_transform(list_filter(l, lambda r: list_contains(r.m, facets[turn].facet) AND NOT list_contains(taken, r.n)), lambda r: r.n)[1:1]) FROM cover WHERE turn <= len(facets)),
 cov AS (SELECT query_id, unnest(taken) AS nn, unnest(range(len(taken))) AS c FROM cover WHERE turn = len(facets) + 1),
 mp AS (SELECT mo.*, row_number() OVER (PARTITION BY mo.query_id ORDER BY coalesce(c, 1073741824), mo.nn) AS place FROM mo LEFT JOIN cov ON cov.query_id = mo.query_id AND cov.nn = mo.nn)"""


@query("merged_evidence", f"{LEXICAL_SQL}{ARTICLE_RANK}, {INTENTS}, {FULL_TEXTS}, {ABSTRACTS}, {MERGED}, {COVERED} SELECT query_id, rid AS article_id, place, \"full\", grade, round(score + 1e-10, 6) AS score FROM mp WHERE place <= 12".replace("WITH ", "WITH RECURSIVE ", 1))
def merged_evidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts and abstracts of each query as one list of twelve."""
    full = full_text_results(spark, sf_dir, 8).select("query_id", F.col("article_id").alias("rid"), "title", "text", "score").join(article_details(spark, sf_dir).select(F.col("article_id").alias("rid"), "doi"), "rid").withColumn("full", F.lit(True))
    bare = abstract_results(spark, sf_dir, 12).select("query_id", "rid", "title", "text", F.col("combined").alias("score"), "doi").withColumn("full", F.lit(False))
    found = merged_evidence(full.unionByName(bare), stored(query_intents(spark, sf_dir), "intents"), 12)
    return found.select("query_id", F.col("rid").alias("article_id"), "place", "full", "grade", F.round(F.col("score") + TIE, 6).alias("score"))


RERANK_SOURCE = """rs AS (SELECT ar.query_id, ar.article_id AS rid, split_part(d.text, chr(10), 1) AS title, split_part(d.text, chr(10), 2) AS text, CASE WHEN d.doc_id % 3 <> 0 THEN '10.5555/ls.' || CAST(d.doc_id // 2 AS VARCHAR) END AS doi, d.doc_id % 5 < 2 AS "full", ar.rank
 FROM ar JOIN documents d ON d.doc_id = ar.article_id WHERE ar.rank <= 40)"""


@query("reranked_articles", f"{LEXICAL_SQL}{ARTICLE_RANK}, {INTENTS}, {RERANK_SOURCE}, {reranked_sql('rs', 'rr')} SELECT query_id, rid AS article_id, place AS rank, grade, tier, round(combined + 1e-10, 6) AS score FROM rr WHERE place <= 15")
def reranked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best articles of each query by their abstracts' relevance, the best fifteen."""
    details = article_details(spark, sf_dir)
    ranked = ranked_articles(article_hits(spark, sf_dir), details, search_queries(spark, sf_dir), chunks(spark, sf_dir), 40)
    own = details.select(F.col("article_id").alias("rid"), "title", F.coalesce("abstract", F.lit("")).alias("text"), "doi", F.col("status").isin(VISIBLE).alias("full"))
    records = ranked.select("query_id", F.col("article_id").alias("rid"), "rank").join(own, "rid")
    return reranked(records, query_intents(spark, sf_dir), 15).select("query_id", F.col("rid").alias("article_id"), "rank", "grade", "tier", F.round(F.col("combined") + TIE, 6).alias("score"))


# The weights of a variant's tier, and how many variants a question has.
VARIANT_WEIGHTS = {"strict": 1.0, "near": 0.65, "model": 0.35}
MOST_VARIANTS = 6


def query_variants(queries: DataFrame, asked: DataFrame, swaps: DataFrame, most: int = MOST_VARIANTS) -> DataFrame:
    """``query_id, place, tier, weight, variant``: a question's variants, the question itself first; folded texts that are equal count once, ``most`` at most.

    The second has every phrase of ``swaps(source, target)``, single words, replaced by its counterpart in the other language. A variant for each facet searches the matter, the process and its words,
    strict where the matter itself is named, else near; another one the close matter alone; the last one, of the model tier, the distant matter with the first facet.
    """
    words = queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("n", "source")).join(swaps, "source", "left")
    swapped = words.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("target", "source").alias("w")))).alias("l"), F.count("target").alias("k")).where("k > 0")
    swapped = swapped.select("query_id", F.lit(1).cast("long").alias("n"), F.lit("strict").alias("tier"), F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("variant"))
    own = queries.select("query_id", F.lit(0).cast("long").alias("n"), F.lit("strict").alias("tier"), F.col("query").alias("variant"))
    exact, near, process, far = F.slice("primary", 1, 2), F.slice("close", 1, 5), F.slice("process", 1, 7), F.slice("distant", 1, 4)
    facets = asked.select("query_id", F.posexplode("facets").alias("i", "f"), exact.alias("e"), near.alias("c"), process.alias("p"), far.alias("d"))
    text = lambda *parts: F.array_join(F.array_distinct(F.concat(*parts, F.slice("f.terms", 1, 8))), " ")
    kinds = [
        (F.size("e") + F.size("c") + F.size("p") > 0, 100, F.when(F.size("e") > 0, "strict").otherwise("near"), text("e", "c", "p")),
        (F.size("c") > 0, 1000, F.lit("near"), text("c", "p")),
        ((F.size("d") > 0) & (F.col("i") == 0), 10_000, F.lit("model"), text("d", "p")),
    ]
    made = [facets.where(ok).select("query_id", (F.col("i") + at).cast("long").alias("n"), tier.alias("tier"), variant.alias("variant")) for ok, at, tier, variant in kinds]
    rows = own.unionByName(swapped)
    for m in made:
        rows = rows.unionByName(m)
    rows = first_by(rows.withColumn("_k", F.array_join(tokens(F.col("variant")), " ")).where("_k <> ''"), ["query_id", "_k"], ["n"])
    weight = F.create_map(*[F.lit(x) for kv in VARIANT_WEIGHTS.items() for x in kv])[F.col("tier")]
    return top(rows, ["query_id"], ["n"], most).select("query_id", F.col("rank").alias("place"), "tier", weight.alias("weight"), "variant")


# Fixed values for the stored questions: words of two languages that mean the same.
COUNTERPARTS = {"the": "le", "and": "et", "with": "avec", "der": "the", "und": "and", "les": "the", "des": "of"}
SWAPPED = ", ".join(f"('{a}', '{b}')" for a, b in COUNTERPARTS.items())


def variant_text(parts: str) -> str:
    return f"array_to_string(list_filter({parts}, lambda x, j: list_position({parts}, x) = j), ' ')"


@query(
    "query_variants",
    f"""WITH {INTENTS}, sw(source, target) AS (VALUES {SWAPPED}), fx AS (SELECT query_id, f.facet AS facet, i, "primary"[1:2] AS e, close[1:5] AS c, process[1:7] AS p, "distant"[1:4] AS d, f.terms[1:8] AS t FROM (SELECT query_id, "primary", close, process, "distant", unnest(facets) AS f, unnest(range(len(facets))) AS i FROM intents)),
 vs AS (SELECT item_id AS query_id, 0 AS n, 'strict' AS tier, text AS variant FROM benchmark UNION ALL SELECT query_id, 1, 'strict', string_agg(coalesce(target, x), ' ' ORDER BY pos) FROM (SELECT query_id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM qw) LEFT JOIN sw ON source = x GROUP BY query_id HAVING count(target) > 0
  UNION ALL SELECT query_id, 100 + i, CASE WHEN len(e) > 0 THEN 'strict' ELSE 'near' END, {variant_text('list_concat(e, c, p, t)')} FROM fx WHERE len(e) + len(c) + len(p) > 0 UNION ALL SELECT query_id, 1000 + i, 'near', {variant_text('list_concat(c, p, t)')} FROM fx WHERE len(c) > 0
  UNION ALL SELECT query_id, 10000, 'model', {variant_text('list_concat(d, p, t)')} FROM fx WHERE len(d) > 0 AND i = 0),
 vk AS (SELECT *, array_to_string({TOKENS.format(x='variant')}, ' ') AS k FROM vs), vu AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY n) AS r FROM vk WHERE k <> ''), vp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS place FROM vu WHERE r = 1)
 SELECT query_id, place, tier, CASE tier WHEN 'strict' THEN 1.0 WHEN 'near' THEN 0.65 ELSE 0.35 END AS weight, variant FROM vp WHERE place <= 6""",
)
def query_variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_variants(search_queries(spark, sf_dir), query_intents(spark, sf_dir), spark.createDataFrame(list(COUNTERPARTS.items()), "source string, target string"))


def weighted_lexical_lists(rows: DataFrame, variants: DataFrame, key: str, fields: dict[str, float], most: int) -> DataFrame:
    """``query_id, key, score, best_rank``: the variants' lexical lists of ``most`` of ``rows`` each, fused with the weights of their tiers; the search without vectors."""
    asked = variants.select(F.concat_ws("|", F.col("query_id").cast("string"), F.col("place").cast("string")).alias("query_id"), F.explode(F.array_distinct(tokens(F.col("variant")))).alias("term"))
    lists = best_lexical(rows, key, fields, asked, most).withColumnRenamed("query_id", "_v")
    lists = lists.select(F.split_part("_v", F.lit("|"), F.lit(1)).cast("long").alias("query_id"), F.split_part("_v", F.lit("|"), F.lit(2)).cast("int").alias("place"), key, "rank")
    part = F.col("weight") / (RRF_K + F.col("rank"))
    return lists.join(variants.select("query_id", "place", "weight"), ["query_id", "place"]).groupBy("query_id", key).agg(F.sum(part).alias("score"), F.min("rank").alias("best_rank"))


VARIANT_LISTS = """, va AS (SELECT query_id, place, CASE tier WHEN 'strict' THEN 1.0 WHEN 'near' THEN 0.65 ELSE 0.35 END AS weight, unnest(list_distinct({tokens})) AS term FROM vp WHERE place <= 6),
 {postings}, vst AS (SELECT count(*) AS n, avg(len(s) + len(w)) AS mean FROM w0), vdf AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
 vsc AS (SELECT query_id, place, weight, chunk_id, sum(greatest(ln((vst.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / vst.mean))) AS score FROM idx JOIN va USING (term) JOIN vdf USING (term), vst GROUP BY query_id, place, weight, chunk_id),
 vr AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM vsc), vf AS (SELECT query_id, chunk_id, sum(weight / (60 + rank)) AS score, min(rank) AS best_rank FROM vr WHERE rank <= 120 GROUP BY query_id, chunk_id),
 vo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best_rank, chunk_id) AS rank FROM vf)"""


def lexical_fallback_sql() -> str:
    return ORACLES["query_variants"].replace("WITH ", f"WITH {CHUNKS}, ", 1).split("SELECT query_id, place, tier, CASE")[0].rstrip() + VARIANT_LISTS.format(tokens=TOKENS.format(x="variant"), postings=POSTINGS) + " SELECT query_id, chunk_id, round(score, 8) AS score, rank FROM vo WHERE rank <= 20"


@query("lexical_fallback", lexical_fallback_sql())
def lexical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best chunks of each query over all its variants, without vectors."""
    variants = stored(query_variants_query(spark, sf_dir), "variants")
    found = weighted_lexical_lists(chunks(spark, sf_dir), variants, "chunk_id", CHUNK_FIELDS, 120)
    return top(found, ["query_id"], [F.desc(F.round("score", 12)), "best_rank", "chunk_id"], 20).select("query_id", "chunk_id", F.round("score", 8).alias("score"), "rank")
