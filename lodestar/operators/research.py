"""Question routing, evidence gates and scores, audits and reports, corpus merges and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import fold, title_key
from lodestar.operators.entities import KEY
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, CHUNKS, FOLD, HITS, articles, chunks, record_hits
from lodestar.sources.tables import table


def has(x: Column, part: str) -> Column:
    return F.contains(x, F.lit(part))


# --- routing and filters -------------------------------------------------------------------------


@query("latest_answers", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' AND trim(text, ' ') <> '' GROUP BY conv_id")
def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's whole last answer that says something."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant' AND trim(text) <> ''")
    return said.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("answer"))


@query("interaction_mode", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(compare|evidence|study|studies)\\b') THEN 'research' WHEN turn > 0 AND length(text) < 80 THEN 'conversation' WHEN contains(text, '?') OR length(text) > 200 THEN 'research' ELSE 'conversation' END AS mode FROM conversations WHERE role = 'user'")
def interaction_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research or conversation, by the first rule that fits."""
    t = F.col("text")
    mode = F.when(F.lower(t).rlike(r"\b(compare|evidence|study|studies)\b"), "research").when((F.col("turn") > 0) & (F.length(t) < 80), "conversation").when(has(t, "?") | (F.length(t) > 200), "research").otherwise("conversation")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", mode.alias("mode"))


ANCHORS = ["license", "apache", "straß", "beschrei"]
ANCHOR_SQL = " OR ".join(f"contains(f, '{a.replace('ß', 'ss')}')" for a in ANCHORS)


@query("anchor_filter", f"WITH {CHUNKS}, c AS (SELECT chunk_id, {FOLD.format(x='text')} AS f FROM chunks) SELECT chunk_id FROM c WHERE {ANCHOR_SQL}")
def anchor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with at least one anchor in their folded text."""
    anchors = F.transform(F.array(*map(F.lit, ANCHORS)), fold)
    return chunks(spark, sf_dir).select("chunk_id", fold(F.col("text")).alias("f")).where(F.exists(anchors, lambda a: F.contains(F.col("f"), a))).select("chunk_id")


@query("relevance_gate_counts", f"WITH {HITS} SELECT theme, count(*) FILTER (hit_status <> 'rejected' AND score >= 0.06) AS kept, count(*) FILTER (NOT (hit_status <> 'rejected' AND score >= 0.06)) AS refused FROM hits GROUP BY theme")
def relevance_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("hit_status") != "rejected") & (F.col("score") >= 0.06)
    return record_hits(spark, sf_dir).groupBy("theme").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("refused"))


@query("excluded_identifiers", f"WITH {ARTICLES}, x AS (SELECT DISTINCT lower(doi) AS doi FROM articles WHERE status = 'rejected' AND doi IS NOT NULL) SELECT article_id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doi = lower(a.doi))")
def excluded_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose DOI no rejected article has."""
    rows = articles(spark, sf_dir).withColumn("key", F.lower("doi"))
    gone = rows.where("status = 'rejected' AND key IS NOT NULL").select("key").distinct()
    return rows.join(gone, "key", "left_anti").select("article_id")


@query("active_closures", "SELECT user_id, event_type, max(ts) + INTERVAL 2 DAY AS closed_until FROM events GROUP BY 1, 2 HAVING max(ts) + INTERVAL 2 DAY > TIMESTAMP '2024-01-30'")
def active_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return rows.select("user_id", "event_type", F.expr("ts + INTERVAL '2' DAY").alias("closed_until")).where("closed_until > TIMESTAMP_NTZ '2024-01-30'")


@query("repeated_cells", "SELECT user_id, event_type, json_extract_string(props, '$.k') AS cell, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that were submitted more than once."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.get_json_object("props", "$.k").alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- scores --------------------------------------------------------------------------------------

@query("wording_audit", "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(must|should|dürfen|müssen)\\b') AS normative, regexp_matches(lower(text), '\\b(causes?|because|leads? to)\\b') AS causal, regexp_matches(text, '(^|\\n)\\s*[-*] ') AS bulleted FROM conversations WHERE role = 'assistant'")
def wording_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers use words that their sources would have to have."""
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", low.rlike(r"\b(must|should|dürfen|müssen)\b").alias("normative"), low.rlike(r"\b(causes?|because|leads? to)\b").alias("causal"), F.col("text").rlike(r"(^|\n)\s*[-*] ").alias("bulleted"))


@query("specific_titles", f"WITH {ARTICLES} SELECT article_id, length(title) >= 40 AND len(list_filter(string_split_regex(title, '\\s+'), lambda w: w <> '')) >= 5 AND NOT contains(lower(title), 'license') AS specific FROM articles")
def specific_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split("title", r"\s+"), lambda w: w != ""))
    return articles(spark, sf_dir).select("article_id", ((F.length("title") >= 40) & (n >= 5) & ~has(F.lower("title"), "license")).alias("specific"))


@query("normalised_document_hash", "SELECT doc_id, sha256(array_to_string(list_transform(string_split(lower(text), chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'), ' ')), chr(12))) AS hash FROM documents")
def normalised_document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash that spacing and case do not change, pages kept apart."""
    pages = F.transform(F.split(F.lower("text"), "\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(pages, "\f"), 256).alias("hash"))


# --- merges --------------------------------------------------------------------------------------


@query("provisional_twins", f"WITH {ARTICLES}, k AS (SELECT article_id, doi, year, {KEY} AS key FROM articles) SELECT n.article_id AS new_id, min(t.article_id) AS twin_id FROM k n JOIN k t ON n.key = t.key AND n.year = t.year AND t.doi IS NULL WHERE n.doi IS NOT NULL GROUP BY n.article_id")
def provisional_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a DOI and their twin without one: same title and year."""
    own = articles(spark, sf_dir).select("article_id", "doi", "year", title_key(F.col("title")).alias("key"))
    twin = own.where("doi IS NULL").groupBy("key", "year").agg(F.min("article_id").alias("twin_id"))
    return own.where("doi IS NOT NULL").join(twin, ["key", "year"]).select(F.col("article_id").alias("new_id"), "twin_id")


@query("corpus_merge_map", "WITH m AS (SELECT max(c_custkey) AS top FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey AS source_id, c_custkey + top + 1 AS target_id, c_nationkey FROM customer, m WHERE c_custkey % 2 = 1")
def corpus_merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids for the rows of a second corpus, beyond the first one's."""
    rows = table(spark, sf_dir, "customer")
    top = rows.where("c_custkey % 2 = 0").agg(F.max("c_custkey").alias("top"))
    return rows.where("c_custkey % 2 = 1").join(F.broadcast(top)).select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") + F.col("top") + 1).alias("target_id"), "c_nationkey")


@query("scoped_union", "SELECT scope, id, row_number() OVER (ORDER BY balance DESC, scope, id) AS place FROM (SELECT 'customer' AS scope, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier) ORDER BY balance DESC, scope, id LIMIT 50")
def scoped_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fifty of several corpora, each row with its corpus; only those fifty are numbered."""
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("scope"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("scope"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    order = [F.desc("balance"), "scope", "id"]
    best = a.unionByName(b).orderBy(*order).limit(50)
    return best.select("scope", "id", F.row_number().over(Window.orderBy(*order)).alias("place"))


# --- audits and reports --------------------------------------------------------------------------


@query("answerability_report", "SELECT lang, count(*) AS n, round(count(*) FILTER (quality = 1 AND length(text) > 500) / nullif(count(*) FILTER (quality = 1), 0), 6) AS sensitivity, round(count(*) FILTER (quality = 0 AND length(text) <= 500) / nullif(count(*) FILTER (quality = 0), 0), 6) AS specificity FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def answerability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and specificity of a length rule by language."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("l")), "doc_id")
    q, long = F.col("quality") == 1, F.col("l") > 500
    share = lambda a, b: F.round(F.count_if(a & b) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), share(long, q).alias("sensitivity"), share(~long, F.col("quality") == 0).alias("specificity"))


@query("dataset_readiness", "WITH g AS (SELECT lang, count(*) AS n, avg(CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END) AS long FROM documents GROUP BY lang), t AS (SELECT sum(n) AS total FROM g) SELECT lang, n, array_to_string(list_filter([CASE WHEN n < 100 THEN 'too_few' END, CASE WHEN n / total > 0.55 THEN 'too_large_share' END, CASE WHEN long < 0.5 THEN 'too_short' END], lambda x: x IS NOT NULL), ',') AS failures FROM g, t")
def dataset_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and the codes of the minima they miss."""
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.length("text") > 1000).cast("int")).alias("long"))
    g = g.join(F.broadcast(g.agg(F.sum("n").alias("total"))))
    codes = F.array_compact(F.array(F.when(F.col("n") < 100, "too_few"), F.when(F.col("n") / F.col("total") > 0.55, "too_large_share"), F.when(F.col("long") < 0.5, "too_short")))
    return g.select("lang", "n", F.array_join(codes, ",").alias("failures"))


@query("regression_replay", "SELECT l_returnflag AS package, bool_and(l_quantity >= 1) AS passed, count(*) FILTER (l_quantity < 5) AS weak FROM lineitem GROUP BY 1")
def regression_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("package")).agg(F.bool_and(F.col("l_quantity") >= 1).alias("passed"), F.count_if(F.col("l_quantity") < 5).alias("weak"))


@query("run_audit", "WITH p AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice < 5000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN n IS NULL THEN 'empty' END], lambda x: x IS NOT NULL)) AS code FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) SELECT code, count(*) AS n FROM p GROUP BY code")
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of runs, counted by code; a run can have several."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left")
    codes = F.array_compact(F.array(F.when(F.col("o_totalprice") < 5000, "cheap"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("n").isNull(), "empty")))
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("run_recovery", f"WITH {HITS} SELECT o_orderkey AS run_id, count(h.record_id) AS raw, CASE WHEN count(h.record_id) > 0 THEN 'partial' ELSE 'failed' END AS state FROM orders LEFT JOIN hits h ON h.run_id = o_orderkey AND h.hit_status = 'accepted' GROUP BY o_orderkey")
def run_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupted runs: partial if anything was accepted."""
    raw = record_hits(spark, sf_dir).where("hit_status = 'accepted'").groupBy("run_id").agg(F.count("record_id").alias("raw"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")).join(raw, "run_id", "left").na.fill(0, ["raw"])
    return rows.select("run_id", "raw", F.when(F.col("raw") > 0, "partial").otherwise("failed").alias("state"))


@query("availability_audit", f"WITH {ARTICLES} SELECT source, count(DISTINCT doi) AS dois, count(*) FILTER (status IN ('validated','indexed')) AS available, count(*) FILTER (status = 'awaiting_validation') AS waiting, count(DISTINCT CASE WHEN status IN ('validated','indexed') THEN doi END) AS resolved FROM articles GROUP BY source")
def availability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.col("status").isin("validated", "indexed")
    return articles(spark, sf_dir).groupBy("source").agg(F.countDistinct("doi").alias("dois"), F.count_if(shown).alias("available"), F.count_if(F.col("status") == "awaiting_validation").alias("waiting"), F.countDistinct(F.when(shown, F.col("doi"))).alias("resolved"))


@query("stage_timings", "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS seconds, round(max(value), 4) AS slowest, round(quantile_cont(value, 0.5), 4) AS median FROM events GROUP BY 1")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(v), 4).alias("seconds"), F.round(F.max(v), 4).alias("slowest"), F.round(F.percentile(v, F.lit(0.5)), 4).alias("median"))


@query("count_validation", f"WITH {ARTICLES}, {CHUNKS} SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT article_id) FROM chunks) <= (SELECT count(*) FROM articles) AS consistent")
def count_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).agg(F.count(F.lit(1)).alias("articles"))
    c = chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("article_id").alias("owners"))
    v = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("vectors"))
    return a.join(F.broadcast(c)).join(F.broadcast(v)).select("articles", "chunks", "vectors", (F.col("owners") <= F.col("articles")).alias("consistent"))


@query("conversation_export", "SELECT conv_id, string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text."""
    said = F.struct("turn", F.concat(F.lit("**"), "role", F.lit("**: "), "text").alias("s"))
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("x"))
    return own.select("conv_id", F.array_join(F.transform("x", lambda r: r["s"]), "\n\n").alias("markdown"))
