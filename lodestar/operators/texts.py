"""Text operators over whole tables: keys, identifiers, markup, language cues, query variants, parsing of fetched pages and records."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import STOP_WORDS, all_dois, ascii_words, canonical_key, content_terms, coverage, doi_in, fold, jaccard, query_terms, readable_share, title_key, token_count, tokens, verified_doi, without_markup
from lodestar.operators.retrieval import CANDIDATES, lexical_candidates
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, CHUNKS, FOLD, TOKENS, articles, chunks, search_queries
from lodestar.sources.tables import table

FOLDED = FOLD.format(x="title")
STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


@query("title_keys", f"WITH {ARTICLES}, k AS (SELECT article_id, title, year, doi, {FOLDED} AS f, regexp_replace({FOLDED}, '[^a-z0-9]+', '', 'g') AS key FROM articles) SELECT article_id, f AS folded, trim(regexp_replace(f, '[^a-z0-9]+', ' ', 'g'), ' ') AS words, CASE WHEN key = '' THEN sha256(title) ELSE key END AS key, coalesce('doi:' || doi, 'title:' || CASE WHEN key = '' THEN sha256(title) ELSE key END || ':' || CAST(year AS VARCHAR)) AS canonical FROM k")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return articles(spark, sf_dir).select("article_id", fold(t).alias("folded"), ascii_words(t).alias("words"), title_key(t).alias("key"), canonical_key(F.col("doi"), t, F.col("year")).alias("canonical"))


@query("token_statistics", f"SELECT doc_id, len({TOKENS.format(x='text')}) AS words, len(list_distinct({TOKENS.format(x='text')})) AS distinct_words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS n_tokens FROM documents")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"), token_count(F.col("text")).cast("long").alias("n_tokens"))


@query("content_term_counts", f"SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS.format(x='text')}) AS term FROM documents) WHERE NOT list_contains({STOPS}, term) GROUP BY term HAVING count(*) >= 20")
def content_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(content_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("search_terms", f"SELECT item_id AS query_id, len(list_distinct(list_filter({TOKENS.format(x='text')}, lambda t: length(t) >= 2))) AS distinct_terms, least(24, len(list_distinct(list_filter({TOKENS.format(x='text')}, lambda t: length(t) >= 2 OR regexp_matches(t, '^[0-9]+$'))))) AS asked FROM benchmark")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.filter(tokens(F.col("query")), lambda t: F.length(t) >= 2)
    return search_queries(spark, sf_dir).select("query_id", F.size(F.array_distinct(long)).cast("long").alias("distinct_terms"), F.size(query_terms(F.col("query"))).cast("long").alias("asked"))


CITED = "cited AS (SELECT doc_id, 'see https://doi.org/10.5555/LS.' || CAST(doc_id // 2 AS VARCHAR) || '. And (10.5555/ls.' || CAST(doc_id // 3 AS VARCHAR) || ').' AS note FROM documents)"


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    note = F.concat(F.lit("see https://doi.org/10.5555/LS."), F.expr("doc_id div 2").cast("string"), F.lit(". And (10.5555/ls."), F.expr("doc_id div 3").cast("string"), F.lit(")."))
    return table(spark, sf_dir, "documents").select(i, note.alias("note"))


@query("identifiers_in_text", f"WITH {CITED}, e AS (SELECT doc_id, lower(regexp_replace(regexp_extract(note, '10\\.[0-9]{{4,9}}/[^\\s\"<>]+'), '[.,;:)\\]}}]+$', '')) AS first, list_transform(regexp_extract_all(note, '10\\.[0-9]{{4,9}}/[^\\s\"<>]+'), lambda d: lower(regexp_replace(d, '[.,;:)\\]}}]+$', ''))) AS every FROM cited) SELECT doc_id, nullif(first, '') AS doi, len(list_distinct(every)) AS dois FROM e")
def identifiers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("note")
    return cited(spark, sf_dir).select("doc_id", doi_in(n).alias("doi"), F.size(all_dois(n)).cast("long").alias("dois"))


@query("verified_identifiers", f"WITH {ARTICLES} SELECT article_id, CASE WHEN doi IS NOT NULL THEN lower(doi) END AS doi FROM articles")
def verified_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_id", verified_doi(F.upper("doi")).alias("doi"))


@query("citation_edges", f"WITH {CITED}, e AS (SELECT doc_id AS article_id, unnest(list_distinct(list_transform(regexp_extract_all(note, '10\\.[0-9]{{4,9}}/[^\\s\"<>]+'), lambda d: lower(regexp_replace(d, '[.,;:)\\]}}]+$', ''))))) AS doi FROM cited), {ARTICLES}, t AS (SELECT doi, min(article_id) AS target, bool_or(status IN ('validated','indexed')) AS shown FROM articles WHERE doi IS NOT NULL GROUP BY doi) SELECT e.article_id, e.doi, t.target, CASE WHEN t.target IS NULL THEN 'unavailable' WHEN shown THEN 'consulted' ELSE 'metadata_only' END AS state FROM e LEFT JOIN t ON t.doi = e.doi WHERE t.target IS DISTINCT FROM e.article_id")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop from each article's identifiers to the articles that have them; self loops go."""
    edges = cited(spark, sf_dir).select(F.col("doc_id").alias("article_id"), F.explode(all_dois(F.col("note"))).alias("doi"))
    held = articles(spark, sf_dir).where("doi IS NOT NULL").groupBy("doi").agg(F.min("article_id").alias("target"), F.bool_or(F.col("status").isin("validated", "indexed")).alias("shown"))
    state = F.when(F.col("target").isNull(), "unavailable").when(F.col("shown"), "consulted").otherwise("metadata_only")
    return edges.join(held, "doi", "left").where(~F.col("target").eqNullSafe(F.col("article_id"))).select("article_id", "doi", "target", state.alias("state"))


@query("page_texts", "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' '), '') AS text FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", without_markup(F.col("html")).alias("text"))


@query("page_links", "SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href=\"[^\"]*\"')) AS links, count(DISTINCT link) AS targets FROM (SELECT page_id, html, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS link FROM (SELECT page_id, html, regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages)) GROUP BY page_id, html")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.size(F.array_distinct(found)).cast("long").alias("targets"))


@query("web_hits", "WITH h AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages WHERE starts_with(url, 'https://') AND NOT regexp_matches(url, '^https://[^/]*spam')) SELECT title, url, min(page_id) AS page_id FROM h GROUP BY title, url")
def web_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result links: secure ones, off the engines' own hosts, one of each title and address."""
    rows = table(spark, sf_dir, "pages").where(F.col("url").startswith("https://") & ~F.col("url").rlike("^https://[^/]*spam"))
    return rows.groupBy(F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), "url").agg(F.min("page_id").alias("page_id"))


CUES = {"fr": ["le", "la", "les", "de", "des", "et", "un", "une", "est", "dans", "que", "qui"], "en": ["the", "of", "and", "in", "is", "that", "for", "with", "was", "on", "are", "to"]}


def cue_list(lang: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in CUES[lang]) + "]"


@query("language_cues", f"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS w FROM documents), n AS (SELECT doc_id, len(list_intersect(w, {cue_list('fr')})) AS fr, len(list_intersect(w, {cue_list('en')})) AS en FROM w) SELECT doc_id, fr, en, CASE WHEN fr + en = 0 THEN NULL WHEN fr > en THEN 'fr' ELSE 'en' END AS guess FROM n")
def language_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words of two languages, and which has more."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    n = [F.size(F.array_intersect(w, F.array(*map(F.lit, CUES[x])))).cast("long").alias(x) for x in ("fr", "en")]
    found = table(spark, sf_dir, "documents").select("doc_id", *n)
    return found.withColumn("guess", F.when(F.col("fr") + F.col("en") == 0, F.lit(None)).when(F.col("fr") > F.col("en"), "fr").otherwise("en"))


@query("first_plausible_year", "WITH y AS (SELECT o_orderkey, regexp_extract_all('ref ' || CAST(o_orderkey AS VARCHAR) || ' of ' || strftime(o_orderdate, '%Y-%m-%d'), '[0-9]+') AS n FROM orders) SELECT o_orderkey, CAST(list_filter(n, lambda x: regexp_matches(x, '^(19|20)[0-9]{2}$') AND TRY_CAST(x AS BIGINT) <= 2026)[1] AS INTEGER) AS year FROM y")
def first_plausible_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run of four digits that can be a year."""
    said = F.concat(F.lit("ref "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    runs = F.filter(F.regexp_extract_all(said, F.lit("[0-9]+"), F.lit(0)), lambda x: x.rlike("^(19|20)[0-9]{2}$") & (x.try_cast("long") <= 2026))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(runs, F.lit(0)).cast("int").alias("year"))


@query("author_lists", "WITH a AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(p_name || '; ' || p_brand || ' and ' || p_type || ' et ' || p_name, ';| and | et '), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM part) SELECT p_partkey, len(l) AS named, len(list_distinct(list_transform(l, lambda x: lower(x)))) AS authors, l[1] AS first FROM a")
def author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("; "), "p_brand", F.lit(" and "), "p_type", F.lit(" et "), "p_name")
    names = F.filter(F.transform(F.split(raw, ";| and | et "), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(names).cast("long").alias("named"), F.size(F.array_distinct(F.transform(names, F.lower))).cast("long").alias("authors"), F.get(names, F.lit(0)).alias("first"))


# What heads the seven kinds of sections.
HEADINGS = [("abstract", "abstract|summary|resume"), ("introduction", "introduction|background"), ("materials and methods", "methods?|methodology|materials and methods"), ("results", "results?|resultats"), ("discussion", "discussion"), ("conclusion", "conclusions?"), ("references", "references|bibliography|bibliographie")]


def heading(line: Column) -> Column:
    """The section that a line heads: nothing but a known heading, with or without a number and a colon, in 80 characters at most; else null."""
    own = F.trim(F.regexp_replace(fold(line), r"^\s*(?:[0-9]+(?:\.[0-9]+)*|[ivx]+)[.)]?\s+|[\s:.]+$", ""))
    found = F.lit(None).cast("string")
    for name, pattern in reversed(HEADINGS):
        found = F.when(own.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return F.when(F.length(line) <= 80, found)


HEADED = "h AS (SELECT doc_id, i, unnest([CAST(i AS VARCHAR) || '. ' || upper(s) || ':', s || ' ' || l, l, 'IV) ' || s, s]) AS line FROM (SELECT doc_id, l, i, (['Abstract','Introduction','Methods','Results','Discussion','Conclusions','Résultats','References','Other'])[CAST(i % 9 + 1 AS INTEGER)] AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)))"
OWN_LINE = f"trim(regexp_replace(regexp_replace({FOLD.format(x='line')}, '^\\s*(?:[0-9]+(?:\\.[0-9]+)*|[ivx]+)[.)]?\\s+', ''), '[\\s:.]+$', ''), ' ')"


@query("section_headings", f"WITH {HEADED}, o AS (SELECT doc_id, line, {OWN_LINE} AS own FROM h), c AS (SELECT doc_id, CASE WHEN length(line) > 80 THEN NULL " + " ".join(f"WHEN regexp_full_match(own, '{p}') THEN '{n}'" for n, p in HEADINGS) + " END AS section FROM o) SELECT doc_id, section, count(*) AS n FROM c WHERE section IS NOT NULL GROUP BY ALL")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of five shapes put among the lines of the documents, and those that are recognised, by section."""
    names = F.array(*[F.lit(x) for x in ("Abstract", "Introduction", "Methods", "Results", "Discussion", "Conclusions", "Résultats", "References", "Other")])
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).withColumn("s", F.element_at(names, F.col("i") % 9 + 1))
    shapes = [F.concat(F.col("i").cast("string"), F.lit(". "), F.upper("s"), F.lit(":")), F.concat("s", F.lit(" "), "l"), F.col("l"), F.concat(F.lit("IV) "), "s"), F.col("s")]
    found = lines.select("doc_id", F.explode(F.array(*shapes)).alias("line")).select("doc_id", heading(F.col("line")).alias("section")).where("section IS NOT NULL")
    return found.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


def abstract_in(text: Column) -> Column:
    """What stands between a line that heads an abstract and the next heading of an introduction or keywords, or an empty line; null if there is none."""
    found = F.regexp_extract(text, r"(?is)(?:^|\n)\s*(?:abstract|summary)\s*:?\s*\n?(.+?)(?=\n\s*(?:introduction|keywords|key words|1\.)|\n\s*\n|$(?!\n))", 1)
    return F.when(F.trim(found) != "", F.trim(F.regexp_replace(found, r"\s+", " ")))


@query("abstract_sections", "SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g'), ' ') AS abstract FROM documents WHERE trim(string_split(text, chr(10))[1], ' ') <> ''")
def abstract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abstracts of papers that are made of the documents: a heading, the first line, and the rest as the introduction."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    paper = F.concat(F.lit("Title\nABSTRACT:\n"), first, F.lit("\nIntroduction\n"), "text")
    return table(spark, sf_dir, "documents").where(F.trim(first) != "").select("doc_id", abstract_in(paper).alias("abstract"))


@query("sentences", "SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')) AS n FROM documents")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "\x01"), lambda s: F.trim(s) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n"))


@query("question_overlap", f"{CANDIDATES}, q AS (SELECT item_id AS query_id, list_distinct({TOKENS.format(x='text')}) AS w FROM benchmark), c AS (SELECT doc_id, list_distinct({TOKENS.format(x='text')}) AS w FROM documents) SELECT query_id, doc_id, round(CASE WHEN len(q.w) = 0 OR len(c.w) = 0 THEN 0 ELSE len(list_intersect(q.w, c.w)) / len(list_distinct(list_concat(q.w, c.w))) END, 6) AS jaccard, round(CASE WHEN len(q.w) = 0 THEN 0 ELSE len(list_intersect(q.w, c.w)) / len(q.w) END, 6) AS coverage FROM cand JOIN q USING (query_id) JOIN c ON doc_id = article_id")
def question_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness and coverage of each question and the documents of its best chunks."""
    q = search_queries(spark, sf_dir).select("query_id", tokens(F.col("query")).alias("q"))
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    met = c.join(lexical_candidates(spark, sf_dir), "article_id").withColumn("c", tokens(F.col("text"))).join(q, "query_id")
    return met.select("query_id", F.col("article_id").alias("doc_id"), F.round(jaccard(F.col("q"), F.col("c")), 6).alias("jaccard"), F.round(coverage(F.col("q"), F.col("c")), 6).alias("coverage"))


READABLE_SQL = """WITH t AS (SELECT doc_id, text, greatest(1, length(text)) AS n, string_split_regex(trim(text, ' '), '\\s+') AS p FROM documents),
 m AS (SELECT doc_id, length(text) AS l, length(regexp_replace(text, '[^\\x20-\\x7E\\p{L}\\p{N}\\n]', '', 'g')) / n AS visible, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / n AS letters, list_filter(p, lambda x: x <> '') AS w FROM t),
 s AS (SELECT doc_id, round(0.25 * visible + 0.30 * least(1, letters / 0.7) + 0.25 * len(list_filter(w, lambda x: regexp_matches(x, '^[\\p{L}]{2,}[.,;:!?]?$'))) / greatest(1, len(w)) + 0.20 * least(1, l / 80), 6) AS share FROM m)
 SELECT doc_id, share, share >= 0.75 AS admitted FROM s"""


@query("readable_share", READABLE_SQL)
def readable_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much every document looks like text, and whether that admits it."""
    share = readable_share(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", share.alias("share"), (share >= 0.75).alias("admitted"))


@query("citation_labels", "SELECT l_orderkey, string_agg(CASE WHEN a = b THEN 'p. ' || a ELSE 'pp. ' || a || '-' || b END, '; ' ORDER BY a, b) AS label FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS VARCHAR) AS a, CAST(l_linenumber + CAST(l_quantity AS INTEGER) % 3 AS VARCHAR) AS b FROM lineitem) GROUP BY l_orderkey")
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("a"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).cast("string").alias("b")).distinct()
    label = F.when(F.col("a") == F.col("b"), F.concat(F.lit("p. "), "a")).otherwise(F.concat(F.lit("pp. "), "a", F.lit("-"), "b"))
    ordered = F.array_sort(F.collect_list(F.struct("a", "b", label.alias("s"))))
    return pages.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "; ").alias("label"))


@query("bibliography", f"WITH {ARTICLES} SELECT article_id, '@article{{ls' || CAST(article_id AS VARCHAR) || ', title = {{' || title || '}}, year = {{' || CAST(year AS VARCHAR) || '}}' || coalesce(', doi = {{' || doi || '}}', '') || '}}' AS entry FROM articles WHERE status IN ('validated','indexed')".replace("{{", "{").replace("}}", "}"))
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BibTeX entry for every visible article."""
    rows = articles(spark, sf_dir).where(F.col("status").isin("validated", "indexed"))
    doi = F.coalesce(F.concat(F.lit(", doi = {"), "doi", F.lit("}")), F.lit(""))
    entry = F.concat(F.lit("@article{ls"), F.col("article_id").cast("string"), F.lit(", title = {"), "title", F.lit("}, year = {"), F.col("year").cast("string"), F.lit("}"), doi, F.lit("}"))
    return rows.select("article_id", entry.alias("entry"))


def word_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, index``: the places of each word of ``doc_id, words``, where the document is."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part, found = batch.slice(at, 64), []
            for words in part.column(1).to_pylist():
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
                found.append(list(places.items()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.map_(pa.string(), pa.list_(pa.int32())))], ["doc_id", "index"])


@query("inverted_abstracts", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS abstract FROM documents WHERE text IS NOT NULL")
def inverted_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-to-positions maps turned back into texts: the index of every document is built and read again."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    index = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", words.alias("words")).mapInArrow(word_places, "doc_id long, index map<string,array<int>>")
    flat = F.flatten(F.transform(F.map_entries("index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return index.select("doc_id", F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " ").alias("abstract"))


@query("json_fields", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS valid FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))
