"""Filters, joins, aggregates and set operations over articles, chunks, hits, runs and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import fold, title_key
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, CHUNKS, FOLD, HITS, VISIBLE, articles, chunks, record_hits
from lodestar.sources.tables import table

# --- filters -------------------------------------------------------------------------------------


def visible(rows: DataFrame) -> DataFrame:
    """Rows whose ``status`` search may show."""
    return rows.where(F.col("status").isin(VISIBLE))


def optional_filter(rows: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows whose ``column`` is among ``values``; None is no filter, an empty list leaves nothing."""
    return rows if values is None else rows.where(F.col(column).isin(values) if values else F.lit(False))


def all_terms(rows: DataFrame, columns: list[str], terms: list[str]) -> DataFrame:
    """Rows where each term is a literal part of some column, case aside."""
    for term in terms:
        low = F.lit(term.lower())
        found = F.lit(False)
        for c in columns:
            found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), low)
        rows = rows.where(found)
    return rows


@query("visible_articles", f"WITH {ARTICLES} SELECT article_id, year, status FROM articles WHERE status IN ('validated','indexed')")
def visible_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(articles(spark, sf_dir)).select("article_id", "year", "status")


@query("articles_by_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)")
def articles_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("article_by_doi", f"WITH {ARTICLES} SELECT article_id, doi FROM articles WHERE lower(trim(doi, ' ')) = '10.5555/ls.7'")
def article_by_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where(F.lower(F.trim("doi")) == "10.5555/LS.7".lower()).select("article_id", "doi")


@query("optional_section_filter", f"WITH {CHUNKS} SELECT section, count(*) AS n FROM chunks WHERE section IN ('results','discussion') GROUP BY section")
def optional_section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = optional_filter(optional_filter(chunks(spark, sf_dir), "article_id", None), "section", ["results", "discussion"])
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("metadata_terms", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_brand), 'red')) AND (contains(lower(p_name), 'brand#1') OR contains(lower(p_type), 'brand#1') OR contains(lower(p_brand), 'brand#1'))")
def metadata_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_terms(table(spark, sf_dir, "part"), ["p_name", "p_type", "p_brand"], ["Red", "Brand#1"]).select("p_partkey", "p_name")


@query("search_conversations", "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'the ') AND role = 'user'")
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("the ")) & (F.col("role") == "user"))
    return said.select("conv_id").distinct()


@query("keyset_page", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type IN ('click','view') ORDER BY event_id LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where((F.col("event_id") > 500) & F.col("event_type").isin("click", "view"))
    return rows.orderBy("event_id").limit(50).select("event_id", "event_type")


@query("offset_page_with_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")
    return page.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


@query("facet_browse", f"WITH {ARTICLES} SELECT lang, source, count(*) AS n, count(doi) AS with_doi, count(*) FILTER (trim(coalesce(title,''), ' ') <> '') AS titled FROM articles WHERE status <> 'rejected' GROUP BY lang, source")
def facet_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).where("status <> 'rejected'")
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count("doi").alias("with_doi"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) != "").alias("titled"))


@query("eligible_abstracts", f"WITH {ARTICLES} SELECT a.article_id FROM articles a WHERE a.status = 'metadata_only' AND a.doi IS NOT NULL AND trim(a.title, ' ') <> '' AND NOT EXISTS (SELECT 1 FROM articles f WHERE f.status IN ('validated','indexed') AND lower(f.doi) = lower(a.doi))")
def eligible_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir)
    full = visible(rows).select(F.lower("doi").alias("key")).where("key IS NOT NULL").distinct()
    own = rows.where("status = 'metadata_only' AND doi IS NOT NULL AND trim(title) <> ''").withColumn("key", F.lower("doi"))
    return own.join(full, "key", "left_anti").select("article_id")


@query("backfill_candidates", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderstatus = 'F') ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def backfill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-06-01' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").join(done, "c_custkey", "left_anti")
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey", "c_acctbal")


@query("title_lookup", f"WITH {ARTICLES}, t AS (SELECT *, {FOLD.format(x='title')} AS f FROM articles) SELECT article_id, CASE WHEN f = 'that it.' THEN 0 ELSE 1 END AS place FROM t WHERE contains(f, 'that it') OR (length(title) >= 20 AND contains('that it was the ', f))")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fold(F.col("title"))
    rows = articles(spark, sf_dir).where(F.contains(f, F.lit("that it")) | ((F.length("title") >= 20) & F.contains(F.lit("that it was the "), f)))
    return rows.select("article_id", F.when(f == "that it.", 0).otherwise(1).alias("place"))


@query("permanent_failures", "SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' AND NOT (props LIKE '%\"k\": 4%' OR props LIKE '%\"k\": 50%') GROUP BY user_id")
def permanent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.coalesce("props", F.lit(""))
    rows = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & ~(p.like('%"k": 4%') | p.like('%"k": 50%')))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("failures"))


@query("filter_options", f"WITH {ARTICLES} SELECT DISTINCT source AS option FROM articles WHERE trim(source, ' ') <> ''")
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where(F.trim("source") != "").select(F.col("source").alias("option")).distinct().orderBy("option")


# --- joins ---------------------------------------------------------------------------------------


@query("articles_with_chunk_counts", f"WITH {ARTICLES}, {CHUNKS} SELECT a.article_id, count(c.chunk_id) AS n_chunks, count(c.chunk_id) FILTER (c.section = 'results') AS n_results FROM articles a LEFT JOIN chunks c ON a.article_id = c.article_id GROUP BY a.article_id")
def articles_with_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir).groupBy("article_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("section") == "results").alias("n_results"))
    return articles(spark, sf_dir).select("article_id").join(own, "article_id", "left").na.fill(0, ["n_chunks", "n_results"])


@query("run_summaries", "SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    joined = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "left").join(lines, "o_orderkey", "left")
    return joined.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("first_chunk_by_article", f"WITH {CHUNKS} SELECT article_id, min(chunk_id) AS chunk_id, arg_min(section, chunk_index) AS section FROM chunks GROUP BY article_id")
def first_chunk_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("article_id").agg(F.min("chunk_id").alias("chunk_id"), F.min_by("section", "chunk_index").alias("section"))


@query("orders_with_returns", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@query("fully_shipped_orders", "SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_linestatus = 'F')")
def fully_shipped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.bool_and(F.col("l_linestatus") == "F").alias("every"))
    return every.where("every").select("l_orderkey", "lines")


@query("unarchived_records", f"WITH {HITS} SELECT DISTINCT record_id FROM hits h WHERE hit_status = 'rejected' AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = h.record_id AND p.p_size < 40)")
def unarchived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("record_id"))
    return record_hits(spark, sf_dir).where("hit_status = 'rejected'").select("record_id").distinct().join(kept, "record_id", "left_anti")


@query("browse_records", f"WITH {HITS} SELECT p_partkey AS record_id, (SELECT string_agg(DISTINCT theme, ',' ORDER BY theme) FROM hits WHERE record_id = p_partkey) AS themes, (SELECT min(rank) FROM hits WHERE record_id = p_partkey) AS best_rank, (SELECT max(score) FROM hits WHERE record_id = p_partkey) AS best_score FROM part")
def browse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = record_hits(spark, sf_dir).groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("theme")), ",").alias("themes"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"))
    own = own.withColumn("themes", F.when(F.col("themes") != "", F.col("themes")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id")).join(own, "record_id", "left")


@query(
    "match_records_by_priority",
    f"""WITH {ARTICLES}, a AS (SELECT article_id, lower(doi) AS doi, year, CASE WHEN k = '' THEN sha256(title) ELSE k END AS key
      FROM (SELECT *, regexp_replace({FOLD.format(x="title")}, '[^a-z0-9]+', '', 'g') AS k FROM articles)),
    n AS (SELECT * FROM a WHERE article_id % 2 = 1), k AS (SELECT * FROM a WHERE article_id % 2 = 0),
    m AS (SELECT n.article_id AS new_id, k.article_id AS known_id, 1 AS branch FROM n JOIN k ON n.doi = k.doi
      UNION ALL SELECT n.article_id, k.article_id, 2 FROM n JOIN k ON n.key = k.key AND n.year = k.year
      UNION ALL SELECT n.article_id, k.article_id, 3 FROM n JOIN k ON n.key = k.key),
    r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY branch, known_id) AS rn FROM m)
    SELECT new_id, known_id, branch FROM r WHERE rn = 1""",
)
def match_records_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = articles(spark, sf_dir).select("article_id", F.lower("doi").alias("doi"), "year", title_key(F.col("title")).alias("key"))
    new = own.where("article_id % 2 = 1").withColumnRenamed("article_id", "new_id")
    known = own.where("article_id % 2 = 0")
    # Of the known records with one key only the least id can win.
    by_doi = known.where("doi IS NOT NULL").groupBy("doi").agg(F.min("article_id").alias("known_id"))
    by_both = known.groupBy("key", "year").agg(F.min("article_id").alias("known_id"))
    by_key = known.groupBy("key").agg(F.min("article_id").alias("known_id"))
    met = new.join(by_doi, "doi").select("new_id", "known_id", F.lit(1).alias("branch"))
    met = met.unionByName(new.join(by_both, ["key", "year"]).select("new_id", "known_id", F.lit(2).alias("branch")))
    met = met.unionByName(new.join(by_key, "key").select("new_id", "known_id", F.lit(3).alias("branch")))
    best = met.groupBy("new_id").agg(F.min(F.struct("branch", "known_id")).alias("x"))
    return best.select("new_id", F.col("x.known_id").alias("known_id"), F.col("x.branch").alias("branch"))


@query("modal_offset", "SELECT o_orderkey - 4 * l_linenumber AS shift, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND coalesce(o_orderstatus, '') = coalesce(l_linestatus, '') GROUP BY 1 ORDER BY n DESC, shift LIMIT 1")
def modal_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    same = o.join(l, (o.o_orderkey == l.l_orderkey) & o.o_orderstatus.eqNullSafe(l.l_linestatus))
    return same.groupBy((F.col("o_orderkey") - 4 * F.col("l_linenumber").cast("long")).alias("shift")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shift").limit(1)


def hydrated(hits: DataFrame, authority: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """``hits`` with the authority's columns; a hit without a row there is an error unless ``strict`` is false."""
    joined = hits.join(authority.withColumn("_there", F.lit(True)), key, "left" if strict else "inner")
    if strict:
        joined = joined.where(F.when(F.col("_there").isNull(), F.raise_error(F.lit("a hit has no row in the authority table"))).otherwise(F.lit(True)).cast("boolean"))
    return joined.drop("_there")


@query("hydrated_hits", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48")
def hydrated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return hydrated(hits, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select("l_orderkey", "l_linenumber", "p_brand")


@query("library_documents", f"WITH {ARTICLES}, f AS (SELECT doi, min(article_id) AS full_id FROM articles WHERE status IN ('validated','indexed') AND doi IS NOT NULL GROUP BY doi), b AS (SELECT doi, min(article_id) AS abstract_id FROM articles WHERE status = 'metadata_only' AND doi IS NOT NULL GROUP BY doi) SELECT coalesce(f.doi, b.doi) AS doi, full_id, abstract_id, CASE WHEN full_id IS NOT NULL THEN 'full_text' ELSE 'abstract' END AS availability FROM f FULL JOIN b ON f.doi = b.doi")
def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).where("doi IS NOT NULL")
    full = visible(rows).groupBy("doi").agg(F.min("article_id").alias("full_id"))
    abstract = rows.where("status = 'metadata_only'").groupBy("doi").agg(F.min("article_id").alias("abstract_id"))
    return full.join(abstract, "doi", "full_outer").select("doi", "full_id", "abstract_id", F.when(F.col("full_id").isNotNull(), "full_text").otherwise("abstract").alias("availability"))


@query("page_overlap", "SELECT a.l_orderkey, a.l_linenumber AS element, b.l_linenumber AS chunk FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber BETWEEN b.l_linenumber - 1 AND b.l_linenumber + 1 AND a.l_linenumber <> b.l_linenumber")
def page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    a, b = line.withColumnRenamed("l_linenumber", "element"), line.withColumnRenamed("l_linenumber", "chunk")
    return a.join(b, "l_orderkey").where("element BETWEEN chunk - 1 AND chunk + 1 AND element <> chunk")


@query("neighbourhood_chunks", f"WITH {CHUNKS}, anchors AS (SELECT article_id, chunk_index FROM chunks WHERE section = 'results') SELECT c.chunk_id, min(abs(c.chunk_index - a.chunk_index)) AS distance FROM chunks c JOIN anchors a ON c.article_id = a.article_id AND abs(c.chunk_index - a.chunk_index) <= 2 GROUP BY c.chunk_id")
def neighbourhood_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks within two places of an anchor: anchors are spread over the places they reach, so the join stays one of equal keys."""
    rows = chunks(spark, sf_dir)
    reach = rows.where("section = 'results'").select("article_id", "chunk_index", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d"))
    reach = reach.groupBy("article_id", (F.col("chunk_index") + F.col("d")).alias("chunk_index")).agg(F.min(F.abs("d")).cast("long").alias("distance"))
    return rows.join(reach, ["article_id", "chunk_index"]).select("chunk_id", "distance")


@query("latest_order_by_customer", "SELECT o_custkey, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_order_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("question_snapshot_join", "WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS key FROM benchmark), s AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS key FROM conversations WHERE role = 'user'), n AS (SELECT key, count(*) AS n FROM q GROUP BY key) SELECT q.item_id, count(s.conv_id) AS snapshots, max(n.n) AS same_question FROM q LEFT JOIN s ON s.key = q.key JOIN n ON n.key = q.key GROUP BY q.item_id")
def question_snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("key")
    q = table(spark, sf_dir, "benchmark").select("item_id", key)
    s = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", key).groupBy("key").agg(F.count("conv_id").alias("snapshots"))
    n = q.groupBy("key").agg(F.count(F.lit(1)).alias("same_question"))
    return q.join(s, "key", "left").join(n, "key").select("item_id", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), "same_question")


# --- aggregates ----------------------------------------------------------------------------------


@query("corpus_statistics", f"WITH {ARTICLES} SELECT count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'rejected') AS rejected, count(doi) AS with_doi, count(DISTINCT source) AS sources, count(DISTINCT lower(doi)) AS dois, max(year) AS latest FROM articles")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return articles(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "indexed").alias("indexed"), F.count_if(s == "rejected").alias("rejected"), F.count("doi").alias("with_doi"), F.countDistinct("source").alias("sources"), F.countDistinct(F.lower("doi")).alias("dois"), F.max("year").alias("latest"))


@query("status_counts", f"WITH {ARTICLES} SELECT status, count(*) AS n FROM articles GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("run_counts", f"WITH {HITS} SELECT run_id, count(*) AS raw, count(DISTINCT record_id) AS records, count(DISTINCT CASE WHEN hit_status = 'accepted' THEN record_id END) AS accepted FROM hits GROUP BY run_id")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_hits(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("raw"), F.countDistinct("record_id").alias("records"), F.countDistinct(F.when(F.col("hit_status") == "accepted", F.col("record_id"))).alias("accepted"))


@query("acceptance_by_run", f"WITH {HITS} SELECT o_orderkey AS run_id, (SELECT count(DISTINCT record_id) FROM hits WHERE run_id = o_orderkey AND hit_status = 'accepted') AS accepted FROM orders")
def acceptance_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = record_hits(spark, sf_dir).where("hit_status = 'accepted'").groupBy("run_id").agg(F.countDistinct("record_id").alias("accepted"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")).join(accepted, "run_id", "left").na.fill(0, ["accepted"])


@query("sources_by_record", f"WITH {HITS} SELECT record_id, string_agg(DISTINCT theme, ';' ORDER BY theme) AS themes, min(run_id) AS first_run, max(run_id) AS last_run FROM hits GROUP BY record_id")
def sources_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_hits(spark, sf_dir).groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("theme")), ";").alias("themes"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))


@query("themes_as_json", f"WITH {HITS} SELECT record_id, '[\"' || string_agg(DISTINCT theme, '\",\"' ORDER BY theme) || '\"]' AS themes FROM hits GROUP BY record_id")
def themes_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_hits(spark, sf_dir).groupBy("record_id").agg(F.to_json(F.array_sort(F.collect_set("theme"))).alias("themes"))


@query("duplicate_dois", f"WITH {ARTICLES} SELECT lower(trim(doi, ' ')) AS doi, count(*) AS n FROM articles WHERE doi IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where("doi IS NOT NULL").groupBy(F.lower(F.trim("doi")).alias("doi")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("article_scores", f"WITH {CHUNKS}, s AS (SELECT article_id, chunk_id, length(text) % 97 AS score FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_id) AS rn FROM s) SELECT article_id, CAST(max(score) AS BIGINT) AS best, avg(score) FILTER (rn <= 3) AS top3, count(*) AS matched, array_to_string(list(chunk_id ORDER BY rn) FILTER (rn <= 3), ',') AS top_ids FROM r GROUP BY article_id")
def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per article: best chunk score, mean of the three best, matches, and the best chunks' ids."""
    scored = chunks(spark, sf_dir).select("article_id", "chunk_id", (F.length("text") % 97).cast("long").alias("score"))
    ranked = scored.withColumn("rn", F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("score"), "chunk_id")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "chunk_id")))), lambda x: x["chunk_id"].cast("string"))
    return ranked.groupBy("article_id").agg(F.max("score").alias("best"), F.avg(F.when(F.col("rn") <= 3, F.col("score"))).alias("top3"), F.count(F.lit(1)).alias("matched"), F.array_join(top, ",").alias("top_ids"))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``n`` and a digest of the rows' contents that no order and no partitioning changes: two sums of parts of each row's hash, so that rows count each by itself."""
    said = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))
    part = lambda at: F.conv(F.substring(said, at, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("low"), F.sum(part(13)).alias("high"))


def digest_sql(source: str, columns: str) -> str:
    return f"SELECT count(*) AS n, sum(CAST(('0x' || md5({columns})[1:12]) AS BIGINT)) AS low, sum(CAST(('0x' || md5({columns})[13:24]) AS BIGINT)) AS high FROM {source}"


@query("corpus_fingerprint", f"WITH {ARTICLES}, f AS (SELECT article_id, sha256(body) AS sha, status FROM articles) " + digest_sql("f", "concat_ws('|', CAST(article_id AS VARCHAR), sha, status)"))
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the articles' ids, contents and statuses."""
    return table_digest(articles(spark, sf_dir).select("article_id", F.sha2("body", 256).alias("sha"), "status"), ["article_id", "sha", "status"])


@query("index_snapshot_digest", f"WITH {ARTICLES}, {CHUNKS}, f AS (SELECT chunk_id, md5(c.text) AS hash FROM chunks c JOIN articles a USING (article_id) WHERE a.status = 'indexed') " + digest_sql("f", "concat_ws('|', CAST(chunk_id AS VARCHAR), hash)"))
def index_snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the chunks of indexed articles, to tell whether an index is still theirs."""
    shown = articles(spark, sf_dir).where("status = 'indexed'").select("article_id")
    own = chunks(spark, sf_dir).join(shown, "article_id", "left_semi").select("chunk_id", F.md5("text").alias("hash"))
    return table_digest(own, ["chunk_id", "hash"])


# --- set operations ------------------------------------------------------------------------------


@query("best_of_two_lists", f"WITH {HITS}, u AS (SELECT record_id, score, 'a' AS origin FROM hits WHERE theme = 'theme1' UNION ALL SELECT record_id, score - 0.02, 'b' FROM hits WHERE theme = 'theme2'), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, origin) AS rn FROM u) SELECT record_id, score, origin FROM r WHERE rn = 1")
def best_of_two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = record_hits(spark, sf_dir)
    a = hits.where("theme = 'theme1'").select("record_id", "score", F.lit("a").alias("origin"))
    b = hits.where("theme = 'theme2'").select("record_id", (F.col("score") - 0.02).alias("score"), F.lit("b").alias("origin"))
    best = a.unionByName(b).groupBy("record_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "origin")).alias("x"))
    return best.select("record_id", (-F.col("x.s")).alias("score"), F.col("x.origin").alias("origin"))


@query("index_reconciliation", f"WITH {CHUNKS}, i AS (SELECT chunk_id, article_id FROM chunks WHERE chunk_id % 11 <> 3 UNION ALL SELECT -chunk_id - 1, article_id FROM chunks WHERE chunk_id % 13 = 5) SELECT CASE WHEN i.chunk_id IS NULL THEN 'missing' WHEN c.chunk_id IS NULL THEN 'stale' WHEN i.article_id <> c.article_id THEN 'invalid' ELSE 'valid' END AS state, count(*) AS n FROM chunks c FULL JOIN i ON i.chunk_id = c.chunk_id GROUP BY 1")
def index_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of chunks that the index lacks, has for nothing, has wrongly, and has rightly."""
    own = chunks(spark, sf_dir).select("chunk_id", "article_id")
    index = own.where("chunk_id % 11 <> 3").unionByName(own.where("chunk_id % 13 = 5").withColumn("chunk_id", -F.col("chunk_id") - 1))
    index = index.select("chunk_id", F.col("article_id").alias("indexed_article"))
    joined = own.join(index, "chunk_id", "full_outer")
    state = F.when(F.col("indexed_article").isNull(), "missing").when(F.col("article_id").isNull(), "stale").when(F.col("indexed_article") != F.col("article_id"), "invalid").otherwise("valid")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("key_set_difference", "SELECT 'left' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'right', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)")
def key_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a.subtract(b), "left").unionByName(count(b.subtract(a), "right"))


@query("eligibility_changes", f"WITH {ARTICLES} SELECT article_id, status, CASE WHEN status = 'indexed' AND doi IS NULL THEN 'demote' WHEN status = 'metadata_only' AND doi IS NOT NULL THEN 'requeue' ELSE 'keep' END AS change FROM articles")
def eligibility_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when((F.col("status") == "indexed") & F.col("doi").isNull(), "demote").when((F.col("status") == "metadata_only") & F.col("doi").isNotNull(), "requeue").otherwise("keep")
    return articles(spark, sf_dir).select("article_id", "status", change.alias("change"))
