"""Deep-research retrieval: the lists of all variants of a question fused at once, with anchors, a cascade, and one provenance for each passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import fold, tokens
from lodestar.operators.evidence import VARIANT_LISTS, lexical_fallback_sql, query_variants_query
from lodestar.operators.phrases import anchors
from lodestar.operators.retrieval import CHUNK_FIELDS, VECTOR_OF, best_lexical, nearest, small, stand_in_vectors, top
from lodestar.plans.registry import ORACLES, query
from lodestar.sources.bindings import FOLD, articles, chunks, search_queries
from lodestar.sources.tables import stored

# The reciprocal-rank constant; how many fused passages, how many for a pair model, and how many in the end.
RRF_K, FUSED, JUDGED, RETAINED = 60, 80, 40, 12
#: Rows of each list.
LIST_ROWS = 40


def anchored(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """``hits(query_id, …, title, text)`` whose folded title or text has one of the question's anchors, ``asked(query_id, anchors)``; all hits of a question without anchors."""
    said = fold(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    held = hits.join(asked.select("query_id", F.col("anchors").alias("_anchors")), "query_id", "left").withColumn("_said", said)
    ok = F.coalesce(F.size("_anchors"), F.lit(0)) <= 0
    return held.where(ok | F.exists("_anchors", lambda a: F.contains(F.col("_said"), fold(a)))).drop("_anchors", "_said")


def deep_fused(hits: DataFrame, weights: DataFrame, asked: DataFrame, model: DataFrame | None = None, model_weight: float = 0.5) -> DataFrame:
    """``query_id, rank, scope, article_id, chunk_id, score, sources, raw_hits, fused, judged`` of ``hits(query_id, variant, method, scope, article_id, chunk_id, rank, title, text, page_start, page_end)``.

    * A hit without an anchor of the question counts as raw only. A vector list's ranks are counted anew over what is left, a lexical list's stay.
    * Passages add up ``weight / (60 + rank)`` over all variants and both methods (``weights(query_id, variant, weight)``). The 80 best are fused candidates,
      40 of them go to the pair model (``model(query_id, scope, article_id, chunk_id, model_score)``, mixed in by ``model_weight``), 12 are retained; ties go by article and chunk.
    * One passage in two hits with other texts or pages has no sure provenance: the query fails with ``conflicting provenance``.
    """
    key = ["query_id", "scope", "article_id", "chunk_id"]
    raw = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("raw_hits"))
    kept = anchored(hits, asked)
    again = F.row_number().over(Window.partitionBy("query_id", "variant", "method", "scope").orderBy("rank", "article_id", "chunk_id"))
    kept = kept.withColumn("rank", F.when(F.col("method") == "vector", again).otherwise(F.col("rank")))
    # a passage counts once in a list, at its first rank
    proof = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "page_start", "page_end")
    first = kept.groupBy(*key, "variant", "method").agg(F.min("rank").alias("rank"), F.min(proof).alias("low"), F.max(proof).alias("high"))
    part = F.col("weight") / (RRF_K + F.col("rank"))
    name = F.concat_ws(":", "method", F.col("variant").cast("string"))
    fused = first.join(weights, ["query_id", "variant"]).groupBy(*key).agg(F.sum(part).alias("score"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("sources"), F.min("low").alias("low"), F.max("high").alias("high"))
    sure = F.when(F.col("low") != F.col("high"), F.raise_error(F.concat(F.lit("conflicting provenance of passage "), F.col("chunk_id").cast("string")))).otherwise(F.col("score"))
    fused = fused.withColumn("score", sure.cast("double")).drop("low", "high")
    counted = fused.withColumn("fused", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    order = [F.desc(F.round("score", 12)), "article_id", "chunk_id"]
    judged = top(counted, ["query_id"], order, min(FUSED, JUDGED)).withColumn("judged", F.least("fused", F.lit(JUDGED)))
    if model is not None:
        judged = judged.join(model, key, "left").withColumn("score", F.when(F.col("model_score").isNull(), F.col("score")).otherwise((1 - model_weight) * F.col("score") + model_weight * F.col("model_score")))
        judged = top(judged.withColumnRenamed("rank", "_was"), ["query_id"], [F.desc(F.round("score", 12)), "_was"], RETAINED).drop("_was", "model_score")
    return judged.where(F.col("rank") <= RETAINED).join(raw, "query_id").select(*key[:1], "rank", *key[1:], "score", "sources", "raw_hits", "fused", "judged")


def variant_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The hits of all variants of the stored questions, lexical and vector, and the variants' weights."""
    variants = stored(query_variants_query(spark, sf_dir), "variants")
    name = (F.col("query_id") * 10 + F.col("place")).cast("long").alias("query_id")
    terms = variants.select(name, F.explode(F.array_distinct(tokens(F.col("variant")))).alias("term"))
    lexical = best_lexical(chunks(spark, sf_dir), "chunk_id", CHUNK_FIELDS, terms, LIST_ROWS)
    vectors = stand_in_vectors(chunks(spark, sf_dir), "chunk_id", "text").withColumnRenamed("chunk_id", "id")
    near = nearest(vectors, stand_in_vectors(variants.select(name, "variant"), "query_id", "variant"), LIST_ROWS)
    lists = lexical.select("query_id", "chunk_id", "rank", F.lit("lexical").alias("method")).unionByName(near.select("query_id", F.col("id").alias("chunk_id"), "rank", F.lit("vector").alias("method")))
    lists = lists.withColumn("variant", (F.col("query_id") % 10).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 10).cast("long"))
    # only the hits' articles are cut into chunks
    lists = stored(lists, "lists")
    its = small(lists.select(F.floor(F.col("chunk_id") / 100000).cast("long").alias("article_id")).distinct(), lists.count())
    own = chunks(spark, sf_dir).join(its, "article_id", "left_semi").select("chunk_id", "article_id", "text", F.col("chunk_index").alias("page_start"), F.col("chunk_index").alias("page_end"))
    hits = lists.join(own, "chunk_id").join(articles(spark, sf_dir).select("article_id", "title"), "article_id").withColumn("scope", F.lit("common"))
    return hits, variants.select("query_id", F.col("place").cast("int").alias("variant"), "weight")


DEEP = (
    lexical_fallback_sql().split(" SELECT query_id, chunk_id, round(score, 8)")[0]
    + f""", vv AS (SELECT query_id, place, CASE tier WHEN 'strict' THEN 1.0 WHEN 'near' THEN 0.65 ELSE 0.35 END AS weight, {VECTOR_OF.format(x='variant')} AS v FROM vp WHERE place <= 6), cv AS (SELECT chunk_id, {VECTOR_OF.format(x='text')} AS v FROM chunks),
 vn AS (SELECT query_id, place, weight, chunk_id, round(CASE WHEN list_sum(vv.v) = 0 OR list_sum(cv.v) = 0 THEN 0 ELSE list_cosine_similarity(vv.v, cv.v) END, 9) AS s FROM vv, cv), vm AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY s DESC, chunk_id) AS rank FROM vn),
 an AS ({ORACLES['question_anchors'].replace("SELECT query_id, array_to_string(l[1:12], ' ') AS anchors FROM d", "SELECT query_id, l[1:12] AS anchors FROM d")}),
 dl AS (SELECT query_id, place, weight, 'lexical' AS method, chunk_id, rank FROM vr WHERE rank <= {LIST_ROWS} UNION ALL SELECT query_id, place, weight, 'vector', chunk_id, rank FROM vm WHERE rank <= {LIST_ROWS}),
 dh AS (SELECT dl.*, c.article_id, {FOLD.format(x="split_part(d.text, chr(10), 1) || chr(10) || c.text")} AS said, anchors FROM dl JOIN chunks c ON c.chunk_id = dl.chunk_id JOIN documents d ON d.doc_id = c.article_id LEFT JOIN an USING (query_id)),
 dk AS (SELECT *, row_number() OVER (PARTITION BY query_id, place, method ORDER BY rank, article_id, chunk_id) AS again FROM dh WHERE coalesce(len(anchors), 0) = 0 OR len(list_filter(anchors, lambda a: contains(said, {FOLD.format(x='a')}))) > 0),
 df AS (SELECT query_id, article_id, chunk_id, sum(weight / (60 + CASE WHEN method = 'vector' THEN again ELSE rank END)) AS score, string_agg(method || ':' || place, ',' ORDER BY method || ':' || place) AS sources FROM dk GROUP BY query_id, article_id, chunk_id),
 dp AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, article_id, chunk_id) AS rank FROM df), dc AS (SELECT query_id, count(*) AS raw_hits FROM dh GROUP BY query_id)
 SELECT query_id, rank, 'common' AS scope, article_id, chunk_id, round(score, 8) AS score, sources, raw_hits, fused, least(fused, 40) AS judged FROM dp JOIN dc USING (query_id) WHERE rank <= 12"""
)


@query("deep_research_fusion", DEEP)
def deep_research_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve passages of each question that all its variants' lists together put first."""
    hits, weights = variant_hits(spark, sf_dir)
    asked = search_queries(spark, sf_dir).select("query_id", anchors(F.col("query")).alias("anchors"))
    return deep_fused(hits, weights, asked).withColumn("score", F.round("score", 8))
