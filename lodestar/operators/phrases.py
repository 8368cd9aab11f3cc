"""Phrases of questions, titles and answers: folds, lines, variants, concepts, anchors, styles, and values of headers and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import STOP_WORDS, fold, tokens
from lodestar.operators.retrieval import CANDIDATES, lexical_candidates
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, FOLD, TOKENS, articles, search_queries
from lodestar.sources.tables import table

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def plain_signs(x: Column) -> Column:
    """The folded text with every punctuation mark and symbol outside ASCII as a blank; ASCII ones stay."""
    return fold(F.regexp_replace(x, r"[\p{P}\p{S}&&[^\x00-\x7F]]", " "))


@query("plain_signs", f"WITH {ARTICLES}, t AS (SELECT article_id, '«' || title || '» – ' || source || '…(x)' AS x FROM articles) SELECT article_id, {FOLD.format(x="regexp_replace(x, '[«»–…]', ' ', 'g')")} AS folded FROM t")
def plain_signs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("«"), "title", F.lit("» – "), "source", F.lit("…(x)"))
    return articles(spark, sf_dir).select("article_id", plain_signs(said).alias("folded"))


def meaningful_line(text: Column, fallback: Column) -> Column:
    """The first line of 8 to 500 characters that does not begin with ``doi``, else ``fallback``."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(8, 500) & ~F.lower(x).startswith("doi"))
    return F.coalesce(F.get(lines, F.lit(0)), fallback)


@query("meaningful_lines", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 8 AND 500 AND NOT starts_with(lower(x), 'doi'))[1], 'untitled') AS line FROM documents")
def meaningful_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", meaningful_line(F.col("text"), F.lit("untitled")).alias("line"))


def filename_titles(name: Column) -> Column:
    """Titles that a file's name may stand for: without its ending, with blanks for joiners, without a leading number; distinct, in that order."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    spaced = F.trim(F.regexp_replace(stem, "[_-]+", " "))
    bare = F.trim(F.regexp_replace(spaced, "^[0-9]+ ", ""))
    return F.array_distinct(F.filter(F.array(stem, spaced, bare), lambda x: x != ""))


@query("filename_titles", f"WITH {ARTICLES}, n AS (SELECT article_id, CAST(year AS VARCHAR) || '_' || replace(title, ' ', '-') || '.pdf' AS name FROM articles), s AS (SELECT article_id, regexp_replace(name, '\\.[A-Za-z0-9]{{1,5}}$', '') AS stem FROM n), p AS (SELECT *, trim(regexp_replace(stem, '[_-]+', ' ', 'g'), ' ') AS spaced FROM s), b AS (SELECT *, trim(regexp_replace(spaced, '^[0-9]+ ', ''), ' ') AS bare FROM p) SELECT article_id, CASE WHEN spaced = stem THEN 1 ELSE 2 END + CASE WHEN bare IN ('', stem, spaced) THEN 0 ELSE 1 END AS variants, CASE WHEN bare = '' THEN spaced ELSE bare END AS last FROM b")
def filename_titles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filename_titles(F.concat(F.col("year").cast("string"), F.lit("_"), F.replace("title", F.lit(" "), F.lit("-")), F.lit(".pdf")))
    return articles(spark, sf_dir).select("article_id", F.size(found).cast("long").alias("variants"), F.element_at(found, -1).alias("last"))


def concept_coverage(concepts: Column, words: Column, without: float) -> Column:
    """The share of ``concepts``, folded phrases, that stand whole in a stream of ``words``; ``without`` if there are no concepts."""
    said = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    held = F.size(F.filter(concepts, lambda c: F.contains(said, F.concat(F.lit(" "), c, F.lit(" ")))))
    return F.when(F.size(concepts) == 0, without).otherwise(held / F.size(concepts))


@query("concept_coverage", f"{CANDIDATES}, c AS (SELECT item_id, list_filter([array_to_string(w[1:2], ' '), array_to_string(w[4:6], ' '), w[2]], lambda x: x <> '') AS c FROM (SELECT item_id, {TOKENS.format(x='text')} AS w FROM benchmark)), d AS (SELECT doc_id, ' ' || array_to_string({TOKENS.format(x='text')}, ' ') || ' ' AS s FROM documents) SELECT item_id, doc_id, round(CASE WHEN len(c) = 0 THEN 1 ELSE len(list_filter(c, lambda x: contains(s, ' ' || x || ' '))) / len(c) END, 6) AS recall FROM cand JOIN c ON item_id = query_id JOIN d ON doc_id = article_id")
def concept_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a question's first phrases the documents of its best chunks have."""
    w = tokens(F.col("query"))
    part = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    asked = search_queries(spark, sf_dir).select("query_id", F.filter(F.array(part(1, 2), part(4, 3), part(2, 1)), lambda x: x != "").alias("c"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    met = docs.join(lexical_candidates(spark, sf_dir), "article_id").withColumn("w", tokens(F.col("text"))).join(asked, "query_id")
    return met.select(F.col("query_id").alias("item_id"), F.col("article_id").alias("doc_id"), F.round(concept_coverage(F.col("c"), F.col("w"), 1.0), 6).alias("recall"))


def anchors(question: Column, most: int = 12) -> Column:
    """Capitalised words of five letters or more, but not the question's first word and no function word; distinct, in order, ``most`` at most."""
    inner = F.regexp_replace(question, r"^[\p{L}-]+", "")
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(inner, F.lit(r"\p{Lu}[\p{L}-]{4,}"), F.lit(0)), lambda x: ~fold(x).isin(STOP_WORDS))), 1, most)


@query("question_anchors", f"WITH a AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(regexp_replace(text, '^[\\p{{L}}-]+', ''), '\\p{{Lu}}[\\p{{L}}-]{{4,}}'), lambda x: NOT list_contains({STOPS}, {FOLD.format(x='x')})) AS l FROM benchmark), d AS (SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM a) SELECT query_id, array_to_string(l[1:12], ' ') AS anchors FROM d")
def question_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries(spark, sf_dir).select("query_id", F.array_join(anchors(F.col("query")), " ").alias("anchors"))


def phrases_swapped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The text with each whole phrase replaced by its counterpart, whatever its case, one pair after another."""
    for source, target in pairs:
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_]){source}(?![\p{{L}}\p{{N}}_])", target)
    return text


# Fixed values for the stored texts: phrases of two languages that mean the same, themes with their cues and words, and what asks for lists or forbids them.
SWAPS = [("the", "le"), ("and", "et"), ("with", "avec")]
THEMES = {"copula": (r"(^|[^\p{L}])(is|are|was)([^\p{L}]|$)", "being state"), "link": (r"(^|[^\p{L}])(and|or|und|et)([^\p{L}]|$)", "joint pair"), "place": (r"(^|[^\p{L}])(in|on|at|dans)([^\p{L}]|$)", "site area")}
PROSE, BULLETS = r"(?i)\b(no list|without lists?|sans liste|ohne liste)\b", r"(?i)\b(lists?|bullets?|liste|the|that)\b"


@query("theme_expansion", "SELECT item_id AS query_id, text || coalesce(' ' || nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{w}' END" for _, (p, w) in sorted(THEMES.items())) + "], lambda x: x IS NOT NULL), ' '), ''), '') AS expanded FROM benchmark")
def theme_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the words of the themes that they name, in the themes' order."""
    q = F.lower("query")
    added = F.array_compact(F.array(*[F.when(q.rlike(p), w) for _, (p, w) in sorted(THEMES.items())]))
    return search_queries(spark, sf_dir).select("query_id", F.when(F.size(added) > 0, F.concat_ws(" ", "query", F.array_join(added, " "))).otherwise(F.col("query")).alias("expanded"))


@query("response_style", f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{PROSE}') THEN 'prose' WHEN regexp_matches(text, '{BULLETS}') THEN 'bullets' ELSE 'prose' END AS style FROM conversations WHERE role = 'user'")
def response_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a question wants to be answered: a forbidden list is prose, an asked-for list bullets, anything else prose."""
    t = F.col("text")
    style = F.when(t.rlike(PROSE), "prose").when(t.rlike(BULLETS), "bullets").otherwise("prose")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", style.alias("style"))


FRENCH, ENGLISH = ["le", "la", "les", "et", "des", "est", "dans", "une"], ["the", "and", "of", "is", "in", "a", "to", "that"]


def language_votes(text: Column, asks: bool) -> tuple[Column, Column]:
    """Votes for French and for English: function words, and for questions three for each word that opens one."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
    opens = {"fr": ["quel", "quelle", "comment", "pourquoi", "combien"], "en": ["which", "how", "why", "what", "when"]}
    votes = []
    for lang, words in (("fr", FRENCH), ("en", ENGLISH)):
        n = F.size(F.array_intersect(w, F.array(*map(F.lit, words))))
        votes.append(n + 3 * F.size(F.array_intersect(w, F.array(*map(F.lit, opens[lang])))) if asks else n)
    return votes[0], votes[1]


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("language_switches", f"WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS w FROM conversations), v AS (SELECT conv_id, turn, role, len(list_intersect(w, {quoted(FRENCH)})) + CASE WHEN role = 'user' THEN 3 * len(list_intersect(w, {quoted(['quel', 'quelle', 'comment', 'pourquoi', 'combien'])})) ELSE 0 END AS fr, len(list_intersect(w, {quoted(ENGLISH)})) + CASE WHEN role = 'user' THEN 3 * len(list_intersect(w, {quoted(['which', 'how', 'why', 'what', 'when'])})) ELSE 0 END AS en FROM t) SELECT a.conv_id, a.turn, CASE WHEN q.fr >= q.en THEN 'fr' ELSE 'en' END AS asked, CASE WHEN a.fr + a.en = 0 THEN 'unknown' WHEN (a.fr >= a.en) = (q.fr >= q.en) THEN 'kept' ELSE 'switched' END AS verdict FROM v a JOIN v q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant' AND q.role = 'user'")
def language_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether answers keep the language of the turn before them; a tie is French."""
    rows = table(spark, sf_dir, "conversations")
    asked, said = language_votes(F.col("text"), True), language_votes(F.col("text"), False)
    q = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), (asked[0] >= asked[1]).alias("q_fr"))
    a = rows.where("role = 'assistant'").select("conv_id", "turn", said[0].alias("fr"), said[1].alias("en"))
    verdict = F.when(F.col("fr") + F.col("en") == 0, "unknown").when((F.col("fr") >= F.col("en")) == F.col("q_fr"), "kept").otherwise("switched")
    return a.join(q, ["conv_id", "turn"]).select("conv_id", "turn", F.when(F.col("q_fr"), "fr").otherwise("en").alias("asked"), verdict.alias("verdict"))


def retry_at(value: Column, now: Column) -> Column:
    """The time that a header names: seconds from ``now``, or a date; null if it is neither."""
    seconds = F.trim(value).try_cast("int")
    date = F.try_to_timestamp(F.regexp_replace(F.trim(value), "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.when(seconds >= 0, now + F.make_dt_interval(secs=seconds)).otherwise(date)


@query("retry_times", "WITH h AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN ' ' || CAST(event_id % 900 AS VARCHAR) WHEN 1 THEN strftime(ts + INTERVAL 1 HOUR, '%a, %d %b %Y %H:%M:%S') || ' GMT' ELSE 'soon' END AS v FROM events) SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts + to_seconds(CAST(trim(v, ' ') AS BIGINT)) WHEN 1 THEN date_trunc('second', ts + INTERVAL 1 HOUR) END AS retry_at FROM h")
def retry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When to ask again, from headers of three kinds that are made of the events."""
    i = F.col("event_id")
    date = F.concat(F.date_format(F.expr("ts + INTERVAL '1' HOUR"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    value = F.when(i % 3 == 0, F.concat(F.lit(" "), (i % 900).cast("string"))).when(i % 3 == 1, date).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", retry_at(value, F.col("ts")).alias("retry_at"))


def dug(payload: Column, path: str) -> Column:
    """The value at a dotted path of a nested JSON text; null if a step is missing."""
    return F.get_json_object(payload, "$." + path)


def as_list(value: Column) -> Column:
    """A JSON value as an array of texts: an array's items, a single value as one item, nothing for null."""
    items = F.from_json(value, "array<string>")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), items).otherwise(F.array(value))


@query("nested_records", "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN to_json({'static': {'titles': {'title': [p_name, p_brand]}}}) WHEN p_partkey % 3 = 1 THEN to_json({'static': {'titles': {'title': p_name}}}) ELSE '{}' END AS j FROM part) SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE p_partkey % 3 WHEN 0 THEN json_extract_string(j, '$.static.titles.title[0]') WHEN 1 THEN json_extract_string(j, '$.static.titles.title') END AS first FROM p")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles dug out of nested records that hold one, a list, or none."""
    i = F.col("p_partkey")
    wrap = lambda x: F.to_json(F.struct(F.struct(F.struct(x.alias("title")).alias("titles")).alias("static")))
    payload = F.when(i % 3 == 0, wrap(F.array("p_name", "p_brand"))).when(i % 3 == 1, wrap(F.col("p_name"))).otherwise("{}")
    titles = as_list(dug(payload, "static.titles.title"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(titles).cast("long").alias("n"), F.get(titles, F.lit(0)).alias("first"))


def listed(value: Column) -> Column:
    """A comma-separated text as its distinct trimmed items, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""))


@query("source_lists", "WITH s AS (SELECT p_partkey, list_filter(list_transform(string_split(p_type || ', ' || p_brand || ',,' || p_type, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM part) SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS sources FROM s")
def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat("p_type", F.lit(", "), "p_brand", F.lit(",,"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(listed(value), "|").alias("sources"))
