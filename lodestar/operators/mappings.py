"""Providers' records as the common record: a table of paths, kinds and fallbacks, compiled to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import doi_in, without_markup
from lodestar.operators.selection import squeezed
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, articles

#: The common record: each field's type, in order.
RECORD = {"source_id": "string", "doi": "string", "title": "string", "abstract": "string", "authors": "array<string>", "journal": "string", "year": "int", "citations": "int", "url": "string"}
#: Field, place among its fallbacks, path, kind, and, for people, the paths inside each (joined by a blank).
Rule = tuple[str, int, str, str, str]


def text_at(raw: Column, path: str) -> Column:
    """The text at a JSON path, squeezed; null if it is blank or JSON's null, which a list gives as that word."""
    x = squeezed(F.get_json_object(raw, path))
    return F.when(~x.isin("", "null"), x)


def people_at(raw: Column, path: str, inner: str) -> Column:
    """The names of a list of objects, or of plain texts (no inner paths): parts joined by a blank, blank ones dropped, repeats too."""
    if inner:
        rows = F.from_json(F.get_json_object(raw, path), "array<string>")
        names = F.transform(rows, lambda x: squeezed(F.concat_ws(" ", *(F.get_json_object(x, p) for p in inner.split(" ")))))
    else:
        names = F.transform(F.from_json(F.get_json_object(raw, path), "array<string>"), squeezed)
    names = F.array_distinct(F.filter(names, lambda x: x != ""))
    return F.when(F.size(names) > 0, names)


def split_at(raw: Column, path: str, inner: str) -> Column:
    names = F.array_distinct(F.filter(F.transform(F.split(F.get_json_object(raw, path), inner), squeezed), lambda x: x != ""))
    return F.when(F.size(names) > 0, names)


def inverted_at(raw: Column, path: str) -> Column:
    """A text that is stored as the places of its words."""
    places = F.from_json(F.get_json_object(raw, path), "map<string,array<int>>")
    words = F.array_sort(F.flatten(F.transform(F.map_entries(places), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))))))
    x = F.array_join(F.transform(words, lambda w: w["word"]), " ")
    return F.when(x != "", x)


def value_at(raw: Column, path: str, kind: str, inner: str) -> Column:
    """What a rule finds; null if there is nothing of its kind."""
    if kind == "text":
        return text_at(raw, path)
    if kind == "markup":
        return without_markup(text_at(raw, path))
    if kind == "doi":
        return doi_in(text_at(raw, path))
    if kind == "number":
        whole = F.floor(text_at(raw, path).try_cast("double"))
        return F.when(whole.between(0, 2**31 - 1), whole).cast("int")
    if kind == "year":
        return F.regexp_extract(F.coalesce(text_at(raw, path), F.lit("")), r"(?<![0-9])((?:1[5-9]|20)[0-9]{2})(?![0-9])", 1).try_cast("int")
    if kind == "people":
        return people_at(raw, path, inner)
    if kind == "names":
        return split_at(raw, path, inner)
    if kind == "inverted":
        return inverted_at(raw, path)
    raise ValueError(f"unknown kind {kind}")


def compiled(rules: list[Rule], raw: Column) -> dict[str, Column]:
    """A column for each field of :data:`RECORD`: the first of its rules, by place, that finds something."""
    unknown = {f for f, *_ in rules} - set(RECORD)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    out = {}
    for field, kind in RECORD.items():
        found = [value_at(raw, path, k, inner) for f, _, path, k, inner in sorted(rules) if f == field]
        out[field] = F.coalesce(*found, F.lit(None)).cast(kind) if found else F.lit(None).cast(kind)
    return out


def common_records(raw: DataFrame, specs: dict[str, list[Rule]]) -> DataFrame:
    """``id, provider``, the fields of :data:`RECORD`, and ``error`` of every row of ``raw(id, provider, raw)``; no row stops the others.

    ``error`` is ``unknown provider``, ``no JSON``, ``no title`` or null; a row with an error has no fields. One pass: a provider's rules are read in its rows only.
    """
    j = F.col("raw")
    known = F.col("provider").isin(*specs) if specs else F.lit(False)
    bad = F.when(~F.coalesce(known, F.lit(False)), "unknown provider").when(F.try_parse_json(j).isNull(), "no JSON")
    by_provider = {p: compiled(rules, j) for p, rules in specs.items()}
    fields = {}
    for field, kind in RECORD.items():
        cases = reduce(lambda w, p: w.when((F.col("provider") == p) & bad.isNull(), by_provider[p][field]), specs, F.when(F.lit(False), F.lit(None).cast(kind)))
        fields[field] = cases.cast(kind)
    rows = raw.select("id", "provider", bad.alias("_bad"), *(c.alias(f) for f, c in fields.items()))
    error = F.coalesce("_bad", F.when(F.col("title").isNull(), "no title"))
    return rows.select("id", "provider", *(F.when(error.isNull(), F.col(f)).alias(f) for f in RECORD), error.alias("error"))


# Where five public bibliographic interfaces keep the fields.
SPECS: dict[str, list[Rule]] = {
    "crossref": [
        ("source_id", 0, "$.DOI", "text", ""), ("doi", 0, "$.DOI", "doi", ""), ("title", 0, "$.title[0]", "markup", ""), ("abstract", 0, "$.abstract", "markup", ""), ("authors", 0, "$.author", "people", "$.given $.family"),
        ("journal", 0, "$.container-title[0]", "text", ""), ("year", 0, "$.published-print.date-parts[0][0]", "year", ""), ("year", 1, "$.issued.date-parts[0][0]", "year", ""), ("citations", 0, "$.is-referenced-by-count", "number", ""), ("url", 0, "$.URL", "text", ""),
    ],
    "openalex": [
        ("source_id", 0, "$.id", "text", ""), ("doi", 0, "$.doi", "doi", ""), ("title", 0, "$.display_name", "text", ""), ("title", 1, "$.title", "text", ""), ("abstract", 0, "$.abstract_inverted_index", "inverted", ""), ("authors", 0, "$.authorships", "people", "$.author.display_name"),
        ("journal", 0, "$.primary_location.source.display_name", "text", ""), ("year", 0, "$.publication_year", "year", ""), ("citations", 0, "$.cited_by_count", "number", ""), ("url", 0, "$.primary_location.landing_page_url", "text", ""), ("url", 1, "$.id", "text", ""),
    ],
    "europe_pmc": [
        ("source_id", 0, "$.id", "text", ""), ("doi", 0, "$.doi", "doi", ""), ("title", 0, "$.title", "markup", ""), ("abstract", 0, "$.abstractText", "markup", ""), ("authors", 0, "$.authorString", "names", r",\s*|\.$"),
        ("journal", 0, "$.journalTitle", "text", ""), ("journal", 1, "$.journalInfo.journal.title", "text", ""), ("year", 0, "$.pubYear", "year", ""), ("citations", 0, "$.citedByCount", "number", ""),
    ],
    "datacite": [
        ("source_id", 0, "$.id", "text", ""), ("doi", 0, "$.attributes.doi", "doi", ""), ("doi", 1, "$.id", "doi", ""), ("title", 0, "$.attributes.titles[0].title", "text", ""), ("abstract", 0, "$.attributes.descriptions[0].description", "markup", ""), ("authors", 0, "$.attributes.creators", "people", "$.name"),
        ("journal", 0, "$.attributes.publisher", "text", ""), ("year", 0, "$.attributes.publicationYear", "year", ""), ("citations", 0, "$.attributes.citationCount", "number", ""), ("url", 0, "$.attributes.url", "text", ""),
    ],
    "semantic_scholar": [
        ("source_id", 0, "$.paperId", "text", ""), ("doi", 0, "$.externalIds.DOI", "doi", ""), ("title", 0, "$.title", "text", ""), ("abstract", 0, "$.abstract", "text", ""), ("authors", 0, "$.authors", "people", "$.name"),
        ("journal", 0, "$.venue", "text", ""), ("journal", 1, "$.journal.name", "text", ""), ("year", 0, "$.year", "year", ""), ("citations", 0, "$.citationCount", "number", ""), ("url", 0, "$.url", "text", ""),
    ],
}
NAMES = list(SPECS)


def provider_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, provider, raw``: each stored document as one of five providers writes it, and a sixth that is unknown; some cut off, some without a title."""
    i = F.col("article_id")
    rows = articles(spark, sf_dir).withColumn("_title", F.when(i % 13 != 5, squeezed(F.col("title")))).withColumn("_w", F.slice(F.array_distinct(F.filter(F.split(squeezed(F.col("body")), " "), lambda w: w != "")), 1, 40))
    title, year, cited, doi, url = F.col("_title"), F.col("year"), F.col("n_chars"), F.col("doi"), F.concat(F.lit("https://x.org/"), i.cast("string"))
    obj = lambda **x: F.to_json(F.struct(*(v.alias(k) for k, v in x.items())))
    s = lambda **x: F.struct(*(v.alias(k) for k, v in x.items()))
    name = lambda n: F.concat(F.lit(n), (i % 7).cast("string"))
    places = F.map_from_entries(F.transform("_w", lambda w, k: F.struct(w, F.array(k))))
    shapes = {
        "crossref": F.to_json(F.struct(F.upper(doi).alias("DOI"), F.array(title).alias("title"), F.concat(F.lit("<jats:p>An <b>abstract</b> of "), i.cast("string"), F.lit("</jats:p>")).alias("abstract"), F.array(s(given=name("Ann "), family=F.lit("Li")), s(given=F.lit(None).cast("string"), family=name("Bo"))).alias("author"), F.array(F.col("source")).alias("container-title"), F.when(i % 2 == 0, s(**{"date-parts": F.array(F.array(year))})).alias("published-print"), s(**{"date-parts": F.array(F.array(year, F.lit(3)))}).alias("issued"), cited.alias("is-referenced-by-count"), url.alias("URL"))),
        "openalex": obj(id=url, doi=F.concat(F.lit("https://doi.org/"), doi), title=title, abstract_inverted_index=places, authorships=F.array(s(author=s(display_name=name("Ann "))), s(author=s(display_name=name("Ann ")))), publication_year=year, cited_by_count=cited, primary_location=s(source=s(display_name=F.col("source")))),
        "europe_pmc": obj(id=i.cast("string"), doi=doi, title=F.concat(F.lit("<i>"), title, F.lit("</i>")), abstractText=F.lit("x &lt; y"), authorString=F.concat(name("Li A"), F.lit(", Bo B.")), journalInfo=s(journal=s(title=F.col("source"))), pubYear=year.cast("string"), citedByCount=cited.cast("string")),
        "datacite": obj(id=doi, attributes=s(titles=F.array(s(title=title)), descriptions=F.array(s(description=F.lit("<p>Data</p>"))), creators=F.array(s(name=name("Li, A"))), publisher=F.col("source"), publicationYear=year, citationCount=-cited, url=url)),
        "semantic_scholar": obj(paperId=F.sha1(i.cast("string")), externalIds=s(DOI=doi), title=title, abstract=F.lit(" "), authors=F.array(s(name=name("Ann ")), s(name=F.lit(" "))), venue=F.lit(""), journal=s(name=F.col("source")), year=year, citationCount=cited, url=url),
    }
    raw = F.lit("{}")
    for k, p in enumerate(NAMES):
        raw = F.when(i % 6 == k, shapes[p]).otherwise(raw)
    provider = F.element_at(F.array(*map(F.lit, [*NAMES, "nobody"])), (i % 6 + 1).cast("int"))
    return rows.select(i.alias("id"), provider.alias("provider"), F.when(i % 11 == 7, F.substring(raw, 1, 20)).otherwise(raw).alias("raw"))


TITLE = r"nullif(trim(regexp_replace(coalesce(title, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '')"
CLEAN = r'''nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' '), '')'''


@query("common_records", f"""WITH {ARTICLES}, w AS (SELECT article_id, list_filter(string_split(trim(regexp_replace(body, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS l FROM articles),
u AS (SELECT article_id, list_filter(l, lambda x, k: list_position(l, x) = k)[1:40] AS words FROM w),
r AS (SELECT a.*, article_id AS id, (['crossref','openalex','europe_pmc','datacite','semantic_scholar','nobody'])[CAST(article_id % 6 + 1 AS INTEGER)] AS provider, CASE WHEN article_id % 13 <> 5 THEN {TITLE} END AS t, words, 'https://x.org/' || article_id AS link FROM articles a JOIN u USING (article_id)),
e AS (SELECT *, CASE provider WHEN 'crossref' THEN {CLEAN} WHEN 'europe_pmc' THEN {CLEAN} ELSE t END AS said FROM r),
f AS (SELECT *, CASE WHEN provider = 'nobody' THEN 'unknown provider' WHEN article_id % 11 = 7 THEN 'no JSON' WHEN said IS NULL THEN 'no title' END AS error FROM e)
SELECT id, provider, error, CASE WHEN error IS NULL THEN CASE provider WHEN 'crossref' THEN upper(doi) WHEN 'openalex' THEN link WHEN 'europe_pmc' THEN CAST(id AS VARCHAR) WHEN 'datacite' THEN doi ELSE sha1(CAST(id AS VARCHAR)) END END AS source_id,
 CASE WHEN error IS NULL THEN doi END AS doi, CASE WHEN error IS NULL THEN said END AS title,
 CASE WHEN error IS NULL THEN CASE provider WHEN 'crossref' THEN 'An abstract of ' || id WHEN 'openalex' THEN nullif(array_to_string(words, ' '), '') WHEN 'europe_pmc' THEN 'x < y' WHEN 'datacite' THEN 'Data' END END AS abstract,
 CASE WHEN error IS NULL THEN CASE provider WHEN 'crossref' THEN 'Ann ' || id % 7 || ' Li|Bo' || id % 7 WHEN 'openalex' THEN 'Ann ' || id % 7 WHEN 'europe_pmc' THEN 'Li A' || id % 7 || '|Bo B' WHEN 'datacite' THEN 'Li, A' || id % 7 ELSE 'Ann ' || id % 7 END END AS authors,
 CASE WHEN error IS NULL THEN source END AS journal, CASE WHEN error IS NULL THEN year END AS year, CASE WHEN error IS NULL AND (provider <> 'datacite' OR n_chars = 0) THEN CAST(n_chars AS INTEGER) END AS citations,
 CASE WHEN error IS NULL AND provider <> 'europe_pmc' THEN link END AS url FROM f""")
def common_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents, as six providers write them, in one form."""
    rows = common_records(provider_rows(spark, sf_dir), SPECS)
    return rows.withColumn("authors", F.when(F.col("authors").isNotNull(), F.array_join("authors", "|")))
