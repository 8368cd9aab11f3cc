"""Passages and claims: chunking, passage selection, excerpts, evidence checks, numeric claims."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import content_terms, coverage, jaccard, tokens
from lodestar.operators.numbers import verdicts
from lodestar.operators.retrieval import article_details, article_hits, ranked_articles
from lodestar.plans.registry import query
from lodestar.sources.bindings import CHUNKS, TOKENS, chunks, search_queries
from lodestar.sources.tables import stored, table

TARGET, MOST, OVERLAP = 420, 512, 80
UNIT_TOKEN = re.compile(r"\w+|[^\w\s]")


def chunked(units: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk, first_page, last_page, n_tokens, text`` from ``units(doc_id, page, pos, section, text)``.

    Units fill a chunk until ``target`` tokens are reached; a change of section or a gap between pages
    closes it. The next chunk begins with the whole units at its end that fit into ``overlap``,
    unless they would overflow ``most``. A unit longer than ``most`` is cut at tokens. The fold streams
    through the documents of a partition, sorted; it holds one chunk at a time.
    """

    def cut(text: str) -> list[tuple[str, int]]:
        found = list(UNIT_TOKEN.finditer(text))
        if len(found) <= most:
            return [(text, len(found))]
        ends = [*range(most, len(found), most), len(found)]
        return [(text[found[a].start() : found[b - 1].end()], b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def folded(rows: Iterable[tuple]) -> Iterator[tuple[int, int, int, str]]:
        held, size, fresh = [], 0, False

        def whole() -> list[tuple[int, int, int, str]]:
            pages = [p for p, _, _, _ in held]
            return [(min(pages), max(pages), size, " ".join(t for _, _, t, _ in held))] if held and fresh else []

        for page, section, said in rows:
            for text, n in cut(said):
                if held and (held[-1][1] != section or page - held[-1][0] > 1):
                    yield from whole()
                    held, size, fresh = [], 0, False
                if fresh and size + n > target:
                    yield from whole()
                    tail, kept = [], 0
                    for unit in reversed(held):
                        if kept + unit[3] > overlap:
                            break
                        tail.insert(0, unit)
                        kept += unit[3]
                    held, size, fresh = tail, kept, False
                if held and size + n > most:
                    held, size = [], 0
                held.append((page, section, text, n))
                size, fresh = size + n, True
        yield from whole()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        chunks = ((doc, i, *c) for doc, own in groupby(units, key=lambda r: r[0]) for i, c in enumerate(folded((page, section, text) for _, page, _, section, text in own)))
        while part := list(islice(chunks, 1000)):
            columns = zip(zip(*part, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["doc_id", "chunk", "first_page", "last_page", "n_tokens", "text"])

    own = units.select("doc_id", "page", "pos", "section", "text").repartition("doc_id").sortWithinPartitions("doc_id", "page", "pos")
    return own.mapInArrow(run, "doc_id long, chunk int, first_page int, last_page int, n_tokens int, text string")


@query("token_chunks")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents: lines are pages, sentences are units."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    units = lines.select("doc_id", "page", F.posexplode(F.split("line", r"(?<=[.!?])\s+(?=[\p{Lu}0-9])")).alias("pos", "text")).where(F.trim("text") != "")
    return chunked(units.withColumn("section", F.lit("body")))


@query("excerpt_candidates", f"WITH {CHUNKS}, s AS (SELECT chunk_id, unnest(l) AS sentence, unnest(range(len(l))) AS pos FROM (SELECT chunk_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM chunks)), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.3 ELSE 0 END + least(len({TOKENS.format(x='sentence')}), 20) / 40 DESC, length(sentence), sentence DESC, pos) AS n FROM s WHERE trim(sentence, ' ') <> '') SELECT chunk_id, n, sentence FROM r WHERE n <= 2")
def excerpt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most telling sentences of each chunk."""
    s = chunks(spark, sf_dir).select("chunk_id", F.posexplode(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "\x01")).alias("pos", "sentence")).where(F.trim("sentence") != "")
    score = F.when(F.col("sentence").rlike("[0-9]"), 0.3).otherwise(0.0) + F.least(F.size(tokens(F.col("sentence"))), F.lit(20)) / 40
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(score), F.length("sentence"), F.desc("sentence"), "pos"))
    return s.withColumn("n", n).where("n <= 2").select("chunk_id", "n", "sentence")


# Bonuses by section, weights of a passage's other marks, words of contrast and of questions about methods, what a measurement looks like, and the roles of sections.
SECTION_BONUS = {"results": 0.25, "discussion": 0.22, "conclusion": 0.24, "abstract": 0.06, "introduction": 0.02, "other": 0.0, "materials and methods": -0.12}
RANK_BONUS, OVERLAP_BONUS, MEASURED_BONUS, CONTRAST_BONUS, METHODS_MALUS, CONTEXT_BONUS = 0.40, 0.22, 0.10, 0.07, 0.12, 0.22
RANKS, CONTEXT_REACH, NEAR, BUDGET, CANDIDATES = 8, 4, 0.85, 32_000, 100
METHODS = ["methods", "materials and methods", "methodology"]
CONTRAST = ["although", "but", "cependant", "contrairement", "contrary", "however", "neanmoins", "not", "whereas"]
METHOD_WORDS = ["assay", "design", "echantillon", "echantillons", "method", "methode", "methodes", "methods", "protocol", "protocole", "sample", "samples"]
MEASURED = r"(?i)(?:\b[0-9]+(?:[.,][0-9]+)?\s*(?:%|°c|mg|g|kg|ml|l|h|hours?|jours?|days?|ppm|ppb)\b|\bp\s*[<=>]\s*0[.,][0-9]+\b|\b(?:mean|median|moyenne|médiane)\b)"
ROLE = {"results": "result", "methods": "method_or_conditions", "materials and methods": "method_or_conditions", "methodology": "method_or_conditions", "discussion": "discussion_or_limit", "conclusion": "discussion_or_limit"}


def looked_up(table: dict, key: Column, otherwise) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(otherwise))


def passage_candidates(hits: DataFrame, texts: DataFrame, queries: DataFrame, radius: int = 1) -> DataFrame:
    """``query_id, article_id, chunk_id, section, text, said, role, pos, score`` of the chunks that passages are taken from.

    ``hits(query_id, article_id, chunk_id, rank)`` are the ranked chunks of the chosen articles, of which the best ``RANKS`` of an article count; with
    them come the first ``CANDIDATES`` chunks of the article. ``pos`` is a ranked chunk's place in its article, from zero. A chunk at most ``radius``
    places from a ranked one has a role in its context.
    """
    terms = lambda c: F.array_distinct(F.filter(content_terms(c), lambda t: F.length(t) >= 2))
    ranked = hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "article_id").orderBy("rank", "chunk_id")) - 1).where(F.col("pos") < RANKS)
    own = texts.withColumn("_n", F.row_number().over(Window.partitionBy("article_id").orderBy("chunk_index", "chunk_id")))
    asked = queries.select("query_id", terms(F.col("query")).alias("terms"))
    anchors = ranked.join(own.select("chunk_id", F.col("chunk_index").alias("at")), "chunk_id").groupBy("query_id", "article_id").agg(F.collect_list("at").alias("anchors"), F.collect_list(F.struct("chunk_id", "pos")).alias("ranked"))
    met = anchors.join(own, "article_id").join(asked, "query_id")
    met = met.withColumn("pos", F.get(F.transform(F.filter("ranked", lambda r: r["chunk_id"] == F.col("chunk_id")), lambda r: r["pos"]), F.lit(0)))
    met = met.where((F.col("_n") <= CANDIDATES) | F.col("pos").isNotNull())
    met = met.withColumn("_near", F.array_min(F.transform("anchors", lambda a: F.abs(a - F.col("chunk_index"))))).withColumn("said", terms(F.col("text")))
    section = F.lower(F.coalesce("section", F.lit("other")))
    methods = section.isin(METHODS)
    wanted = F.arrays_overlap("terms", F.array(*map(F.lit, METHOD_WORDS)))
    score = (
        looked_up(SECTION_BONUS, section, 0.0)
        + F.when(F.col("pos").isNotNull(), RANK_BONUS * F.greatest(F.lit(0.0), 1 - F.col("pos") / RANKS)).otherwise(0.0)
        + OVERLAP_BONUS * coverage(F.col("terms"), F.col("said"))
        + F.when(F.col("text").rlike(MEASURED), MEASURED_BONUS).otherwise(0.0)
        + F.when(F.arrays_overlap("said", F.array(*map(F.lit, CONTRAST))), CONTRAST_BONUS).otherwise(0.0)
        - F.when(methods & ~wanted, METHODS_MALUS).otherwise(0.0)
        + F.when(F.col("_near") <= radius, CONTEXT_BONUS * F.greatest(F.lit(0.0), 1 - F.col("_near") / CONTEXT_REACH)).otherwise(0.0)
    )
    role = F.when(F.col("_near") <= radius, looked_up(ROLE, section, "supporting_context"))
    return met.select("query_id", "article_id", "chunk_id", "section", "text", "said", role.alias("role"), "pos", (methods & ~wanted).alias("deferred"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 9).alias("score"))


def selected_passages(candidates: DataFrame, count: int = 5, least: int = 3, most: int = 8) -> DataFrame:
    """``query_id, article_id, chunk_id, place, score``: passages of each query and article, chosen one after another by score.

    One is passed over if it does not fit into ``BUDGET`` characters, deferred if it is about methods that nobody asked for, if one with
    its role is chosen and others have other roles, or if its words are ``NEAR`` those of a chosen one. If fewer than ``least`` are chosen,
    deferred ones fill up: near repeats, then methods, then roles. The fold goes over one article's candidates, ``CANDIDATES`` or so, as an array.
    """
    item = F.struct((-F.col("score")).alias("s"), "chunk_id", F.length("text").alias("n"), "said", "role", "deferred", F.coalesce("pos", F.lit(RANKS)).alias("pos"))
    groups = candidates.groupBy("query_id", "article_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    groups = groups.withColumn("roles", F.size(F.array_distinct(F.array_compact(F.transform("l", lambda x: x["role"])))))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("ids"), F.lit(0).alias("used"), none.alias("near"), none.alias("methods"), none.alias("same"))
    at = lambda i: F.get(F.col("l"), i)

    def step(a: Column, i: Column) -> Column:
        x = at(i)
        passed = (F.size(a["ids"]) >= count) | (a["used"] + x["n"] > BUDGET)
        same = x["role"].isNotNull() & (F.col("roles") > 1) & F.exists(a["ids"], lambda j: F.coalesce(at(j)["role"] == x["role"], F.lit(False)))
        near = F.exists(a["ids"], lambda j: jaccard(at(j)["said"], x["said"]) >= NEAR)
        to = F.when(passed, "").when(x["deferred"], "methods").when(same, "same").when(near, "near").otherwise("ids")
        grown = {k: F.when(to == k, F.concat(a[k], F.array(i))).otherwise(a[k]).alias(k) for k in ("ids", "near", "methods", "same")}
        return F.struct(grown["ids"], F.when(to == "ids", a["used"] + x["n"]).otherwise(a["used"]).alias("used"), grown["near"], grown["methods"], grown["same"])

    def fill(a: Column, i: Column) -> Column:
        fits = (F.size(a["ids"]) < F.least(F.lit(least), F.size("l"))) & (a["used"] + at(i)["n"] <= BUDGET)
        return F.struct(F.when(fits, F.concat(a["ids"], F.array(i))).otherwise(a["ids"]).alias("ids"), F.when(fits, a["used"] + at(i)["n"]).otherwise(a["used"]).alias("used"))

    groups = groups.withColumn("a", F.aggregate(F.sequence(F.lit(0), F.size("l") - 1), start, step))
    rest = F.aggregate(F.concat("a.near", "a.methods", "a.same"), F.struct(F.col("a.ids").alias("ids"), F.col("a.used").alias("used")), fill)
    groups = groups.withColumn("ids", rest["ids"]).select("query_id", "article_id", "l", "ids")
    chosen = F.array_sort(F.transform("ids", lambda i: F.struct(at(i)["pos"].alias("pos"), at(i)["s"].alias("s"), at(i)["chunk_id"].alias("chunk_id"))))
    placed = groups.select("query_id", "article_id", F.posexplode(F.slice(chosen, 1, most)).alias("at", "x"))
    return placed.select("query_id", "article_id", "x.chunk_id", (F.col("at") + 1).alias("place"), (-F.col("x.s")).alias("score"))


@query("passage_selection")
def passage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each query's ten best articles: candidates come from those articles only."""
    hits, texts, queries = stored(article_hits(spark, sf_dir), "hits"), chunks(spark, sf_dir), search_queries(spark, sf_dir)
    best = ranked_articles(hits, article_details(spark, sf_dir), queries, texts, 10).select("query_id", "article_id")
    found = selected_passages(passage_candidates(hits.join(best, ["query_id", "article_id"]), texts, queries))
    return found.select("query_id", "article_id", "chunk_id", "place", F.round("score", 6).alias("score"))


@query("evidence_checks", f"WITH {CHUNKS}, e AS (SELECT chunk_id, article_id, CASE WHEN chunk_id % 10 = 3 THEN 'not in it' WHEN chunk_id % 10 = 4 THEN text[1:20] ELSE text[3:40] END AS excerpt, CASE WHEN chunk_id % 10 = 5 THEN -chunk_id - 1 ELSE chunk_id END AS cited FROM chunks) SELECT coalesce(CASE WHEN c.chunk_id IS NULL THEN 'unknown_chunk' WHEN NOT contains(c.text, e.excerpt) THEN 'not_verbatim' END, 'valid') AS code, count(*) AS n FROM e LEFT JOIN chunks c ON c.chunk_id = e.cited GROUP BY 1")
def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cited chunks exist and have the excerpt word for word."""
    own = chunks(spark, sf_dir)
    i = F.col("chunk_id")
    excerpt = F.when(i % 10 == 3, "not in it").when(i % 10 == 4, F.substring("text", 1, 20)).otherwise(F.substring("text", 3, 38))
    cited = own.select(excerpt.alias("excerpt"), F.when(i % 10 == 5, -i - 1).otherwise(i).alias("chunk_id"))
    met = cited.join(own.select("chunk_id", "text"), "chunk_id", "left")
    code = F.when(F.col("text").isNull(), "unknown_chunk").when(~F.contains("text", F.col("excerpt")), "not_verbatim").otherwise("valid")
    return met.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


QUANTITY = re.compile(r"(?P<op><=|>=|≤|≥|<|>|≈|~)?\s*(?P<value>[-−+]?[0-9]+(?:[.,][0-9]+)*)(?:\s*(?P<mark>±|-|–|to)\s*(?P<other>[0-9]+(?:[.,][0-9]+)*))?\s*(?P<unit>%|°C|mg/L|µg/L|g/L|kg|mg|g|L|mL|h|min|s|days?)?(?!\w)")
# Spellings of one comparison and of one unit.
OPERATORS = {"≤": "<=", "≥": ">=", "≈": "~"}
UNITS = {"days": "day"}


def canonical_number(x: str) -> str:
    """A number without a plus, leading zeros and trailing decimal zeros; a comma before other than three digits is a decimal point."""
    x = x.replace("−", "-").lstrip("+")
    if "," in x and "." not in x and not re.fullmatch(r"-?[0-9]{1,3}(?:,[0-9]{3})+", x):
        x = x.replace(",", ".", 1)
    x = x.replace(",", "")
    sign, x = ("-", x[1:]) if x.startswith("-") else ("", x)
    whole, _, part = x.partition(".")
    part = part.rstrip("0")
    return sign + (whole.lstrip("0") or "0") + ("." + part if part else "")


def quantities(text: str | None) -> list[str]:
    """Every quantity of a text as ``operator|value|mark|other|unit``."""
    out = []
    for m in QUANTITY.finditer(text or ""):
        other = canonical_number(m["other"]) if m["other"] else ""
        mark = {"–": "-", "to": "-"}.get(m["mark"], m["mark"] or "") if other else ""
        out.append("|".join([OPERATORS.get(m["op"], m["op"] or ""), canonical_number(m["value"]), mark, other, UNITS.get(m["unit"], m["unit"] or "")]))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def quantities_of(text: pd.Series) -> pd.Series:
    return text.map(quantities)


def numeric_verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claim_id, quantities, verdict`` of ``claims(claim_id, text)`` against ``evidence(claim_id, evidence_id, text)``.

    A quantity is supported if one piece of evidence states it in every part. Any that none states
    makes the claim unsupported; if all are stated but not by one piece together, it is ambiguous.
    Units are not converted. A claim without quantities is not numeric.
    """
    need = claims.select("claim_id", F.array_distinct(quantities_of("text")).alias("need"))
    have = evidence.select("claim_id", quantities_of("text").alias("have"))
    met = need.join(have, "claim_id", "left").select("claim_id", "need", F.array_intersect("need", F.coalesce("have", F.array().cast("array<string>"))).alias("found"))
    own = met.groupBy("claim_id").agg(F.first("need").alias("need"), F.max(F.size("found")).alias("most"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("all"))
    n = F.size("need")
    verdict = F.when(n == 0, "not_numeric").when(F.size("all") < n, "unsupported").when(F.col("most") < n, "ambiguous").otherwise("supported")
    return own.select("claim_id", n.cast("long").alias("quantities"), verdict.alias("verdict"))


@query("numeric_claims", """WITH l AS (SELECT l_orderkey AS claim_id, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_discount * 100) AS INTEGER) AS d FROM lineitem),
w AS (SELECT *, 'quantity ' || q || ' kg at ' || d || ' %' AS text FROM l), e AS (SELECT claim_id, arg_min(q, text) AS qa, arg_min(d, text) AS da, arg_max(q, text) AS qb, arg_max(d, text) AS db FROM w GROUP BY claim_id),
t AS (SELECT claim_id, list_distinct(list_concat(['k' || qa, 'd' || da], CASE WHEN claim_id % 3 = 0 THEN ['k' || qb, 'd' || db] ELSE [] END, CASE WHEN claim_id % 5 = 0 THEN ['x'] ELSE [] END)) AS need FROM e),
h AS (SELECT claim_id, n, list_concat(list('k' || q), list('d' || d)) AS have FROM l GROUP BY claim_id, n), s AS (SELECT t.claim_id, need, list_filter(need, lambda k: list_contains(have, k)) AS got FROM t JOIN h ON t.claim_id = h.claim_id)
SELECT claim_id, len(any_value(need)) AS quantities, CASE WHEN len(list_distinct(flatten(list(got)))) < len(any_value(need)) THEN 'unsupported' WHEN max(len(got)) < len(any_value(need)) THEN 'ambiguous' ELSE 'supported' END AS verdict FROM s GROUP BY claim_id""")
def numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about order lines, checked against what the lines of the order say."""
    line = table(spark, sf_dir, "lineitem")
    said = F.concat(F.lit("quantity "), F.col("l_quantity").cast("int").cast("string"), F.lit(" kg at "), F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit(" %"))
    evidence = line.select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("evidence_id"), said.alias("text"))
    claims = evidence.groupBy("claim_id").agg(F.concat_ws(" and ", F.min("text"), F.when(F.col("claim_id") % 3 == 0, F.max("text")), F.when(F.col("claim_id") % 5 == 0, F.lit("77,5 mg/L"))).alias("text"))
    return verdicts(claims, evidence)


@query("claim_admission", "WITH c AS (SELECT l_orderkey AS claim_id, count(*) AS cited, count(*) FILTER (l_returnflag = 'N') AS direct, sum(CAST(l_discount AS DECIMAL(18, 6))) >= 0.04 * count(l_discount) AS enough FROM lineitem GROUP BY 1) SELECT claim_id, CASE WHEN cited = 0 THEN 'rejected' WHEN direct = 0 THEN 'indirect' WHEN enough THEN 'established' ELSE 'tentative' END AS level, direct > 0 AND enough AS admitted FROM c")
def claim_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an order's lines carry it: none of them direct, or a mean discount of 0.04 or not, in exact decimals."""
    enough = F.sum(F.col("l_discount").cast("decimal(18,6)")) >= F.lit("0.04").cast("decimal(3,2)") * F.count("l_discount")
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("l_returnflag") == "N").alias("direct"), enough.alias("enough"))
    level = F.when(F.col("cited") == 0, "rejected").when(F.col("direct") == 0, "indirect").when(F.col("enough"), "established").otherwise("tentative")
    return own.select("claim_id", level.alias("level"), ((F.col("direct") > 0) & F.col("enough")).alias("admitted"))
