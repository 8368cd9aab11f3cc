"""Selections by window: first and best rows, round robins, budgets, quotas, covers, diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import content_terms
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, CHUNKS, HITS, articles, chunks, record_hits
from lodestar.sources.tables import table


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


@query("best_chunk_by_section", f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY article_id, section ORDER BY length(text) DESC, chunk_id) AS n FROM chunks) SELECT article_id, section, chunk_id FROM r WHERE n = 1")
def best_chunk_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(chunks(spark, sf_dir), ["article_id", "section"], [F.desc(F.length("text")), "chunk_id"]).select("article_id", "section", "chunk_id")


@query("first_wins_dedupe", f"WITH {ARTICLES} SELECT coalesce(doi, title) AS key, min(article_id) AS article_id FROM articles GROUP BY 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).groupBy(F.coalesce("doi", "title").alias("key")).agg(F.min("article_id").alias("article_id"))


PLACE = "CASE hit_status WHEN 'accepted' THEN 0 WHEN 'review' THEN 1 ELSE 2 END"


def status_place() -> Column:
    return F.when(F.col("hit_status") == "accepted", 0).when(F.col("hit_status") == "review", 1).otherwise(2)


@query("best_hit_by_record", f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(score, -1) DESC, {PLACE}, theme, run_id, rank) AS n FROM hits) SELECT record_id, theme, score, hit_status FROM r WHERE n = 1")
def best_hit_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.coalesce("score", F.lit(-1.0))), status_place(), "theme", "run_id", "rank"]
    return first_by(record_hits(spark, sf_dir), ["record_id"], order).select("record_id", "theme", "score", "hit_status")


@query("best_theme_by_record", f"WITH {HITS} SELECT record_id, arg_max(theme, (score, -({PLACE}), theme)) AS theme FROM hits GROUP BY record_id")
def best_theme_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_hits(spark, sf_dir).groupBy("record_id").agg(F.max_by("theme", F.struct("score", -status_place(), "theme")).alias("theme"))


@query("round_robin", f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, theme ORDER BY rank, record_id) AS turn FROM hits), g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn, theme, rank, record_id) AS place FROM r) SELECT run_id, record_id, rank, theme, place FROM g WHERE place <= 4")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each run, one hit of each theme after another, four in all."""
    turns = record_hits(spark, sf_dir).withColumn("turn", F.row_number().over(Window.partitionBy("run_id", "theme").orderBy("rank", "record_id")))
    placed = turns.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("turn", "theme", "rank", "record_id")))
    return placed.where("place <= 4").select("run_id", "record_id", "rank", "theme", "place")


@query("character_budget", f"WITH {CHUNKS}, b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY article_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM chunks) SELECT chunk_id, CAST(used AS BIGINT) AS used, substring(text, 1, CAST(1500 - used AS INTEGER)) AS text FROM b WHERE used < 1500")
def character_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's chunks in order while 1500 characters last; the last one is cut."""
    before = Window.partitionBy("article_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    used = chunks(spark, sf_dir).withColumn("used", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    return used.where("used < 1500").select("chunk_id", "used", F.substring("text", F.lit(1), (1500 - F.col("used")).cast("int")).alias("text"))


@query("quota_merge", "WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus = 'F' AS own FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, own ORDER BY o_totalprice DESC, o_orderkey) AS n FROM l), q AS (SELECT *, CASE WHEN own AND n <= 3 THEN 0 WHEN NOT own AND n <= 2 THEN 1 ELSE 2 END AS class FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY class, o_totalprice DESC, o_orderkey) AS place FROM q) SELECT o_custkey, o_orderkey, class, place FROM p WHERE place <= 6")
def quota_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three finished orders of a customer, then two others, then whatever is left, six in all."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("own"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey", "own").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    rows = rows.withColumn("class", F.when(F.col("own") & (F.col("n") <= 3), 0).when(~F.col("own") & (F.col("n") <= 2), 1).otherwise(2))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("class", F.desc("o_totalprice"), "o_orderkey")))
    return placed.where("place <= 6").select("o_custkey", "o_orderkey", "class", "place")


@query("facet_cover", "WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, CASE WHEN n = 1 THEN l_returnflag END, l_extendedprice DESC, l_linenumber) AS place FROM f) SELECT l_orderkey, l_linenumber, l_returnflag, place FROM p WHERE place <= 4")
def facet_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of each flag in the flags' order, then the best of the others, four in all."""
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice").withColumn("n", n)
    own = F.col("n") == 1
    order = [F.when(own, 0).otherwise(1), F.when(own, F.col("l_returnflag")), F.desc("l_extendedprice"), "l_linenumber"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))).where("place <= 4").select("l_orderkey", "l_linenumber", "l_returnflag", "place")


@query("axis_merge", f"WITH {HITS}, m AS (SELECT run_id, record_id, min(rank) AS best, count(DISTINCT theme) AS axes, string_agg(DISTINCT theme, ',' ORDER BY theme) AS memberships FROM hits GROUP BY run_id, record_id) SELECT run_id, record_id, axes, memberships, row_number() OVER (PARTITION BY run_id ORDER BY best, record_id) AS place FROM m")
def axis_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several axes merged by record: first occurrence decides the place, axes are gathered."""
    merged = record_hits(spark, sf_dir).groupBy("run_id", "record_id").agg(F.min("rank").alias("best"), F.countDistinct("theme").alias("axes"), F.array_join(F.array_sort(F.collect_set("theme")), ",").alias("memberships"))
    return merged.select("run_id", "record_id", "axes", "memberships", F.row_number().over(Window.partitionBy("run_id").orderBy("best", "record_id")).alias("place"))


@query("conversation_cards", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, arg_max(role, turn) AS last_role, arg_max(text, turn) AS latest FROM conversations GROUP BY conv_id")
def conversation_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's number of turns and questions, and its whole latest message."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.max_by("role", "turn").alias("last_role"), F.max_by("text", "turn").alias("latest"))


# Messages of a history window and characters of each; questions before the current one, and characters of all.
WINDOW_TURNS, WINDOW_CHARS, QUESTIONS_BEFORE, QUESTION_CHARS = 10, 2000, 2, 4000
ROLES = ["user", "assistant"]


def squeezed(x: Column) -> Column:
    """A text with every run of white space as one space, none at its ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def history_of(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: of each conversation's last ten messages those of the user and the assistant that say something, squeezed and cut."""
    back = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= WINDOW_TURNS)
    said = back.where(F.col("role").isin(ROLES)).select("conv_id", "turn", "role", squeezed(F.col("text")).alias("text")).where("text <> ''")
    return said.withColumn("text", F.substring("text", 1, WINDOW_CHARS))


def questions_in_context(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, question``: each question of a user behind the two before it that differ from it, the last 4000 characters; blank ones do not count."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.where("role = 'user'").select("conv_id", "turn", squeezed(F.col("text")).alias("text")).where("text <> ''")
    before = [F.lag("text", i).over(w) for i in range(QUESTIONS_BEFORE, 0, -1)]
    parts = [F.when(x != F.col("text"), x) for x in before]
    return said.select("conv_id", "turn", F.right(F.concat_ws(" ", *parts, "text"), F.lit(QUESTION_CHARS)).alias("question"))


SQUEEZED = r"trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"


@query("history_window", f"WITH r AS (SELECT conv_id, turn, role, {SQUEEZED} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn, role, substring(said, 1, 2000) AS text FROM r WHERE back <= 10 AND role IN ('user','assistant') AND said <> ''")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_of(table(spark, sf_dir, "conversations"))


@query("contextual_questions", f"WITH u AS (SELECT conv_id, turn, {SQUEEZED} AS said FROM conversations WHERE role = 'user'), b AS (SELECT *, lag(said, 2) OVER w AS two, lag(said) OVER w AS one FROM u WHERE said <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, right(CASE WHEN two <> said THEN two || ' ' ELSE '' END || CASE WHEN one <> said THEN one || ' ' ELSE '' END || said, 4000) AS question FROM b")
def contextual_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions_in_context(table(spark, sf_dir, "conversations"))


@query("cadence_due", "SELECT user_id, max(ts) AS latest, max(ts) + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20' AS due FROM events GROUP BY user_id")
def cadence_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("latest")).select("user_id", "latest", F.expr("latest + INTERVAL 7 DAYS <= TIMESTAMP_NTZ '2024-01-20'").alias("due"))


@query("query_waves", f"WITH {HITS} SELECT run_id, theme, count(*) AS n, run_id % 4 AS wave, 1 + run_id // 4 AS page FROM hits GROUP BY run_id, theme")
def query_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_hits(spark, sf_dir).groupBy("run_id", "theme").agg(F.count(F.lit(1)).alias("n")).select("run_id", "theme", "n", F.pmod("run_id", F.lit(4)).alias("wave"), (1 + F.expr("run_id div 4")).alias("page"))


SECTION_PLACE = "list_position(['results','discussion','conclusion','abstract','introduction','other','methods'], section)"


@query("section_priority", f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY {SECTION_PLACE}, chunk_index) AS place FROM chunks) SELECT article_id, chunk_id, place FROM r WHERE place <= 3")
def section_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's three most telling chunks, by section."""
    order = F.array_position(F.array(*map(F.lit, ["results", "discussion", "conclusion", "abstract", "introduction", "other", "methods"])), F.col("section"))
    rows = chunks(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("article_id").orderBy(order, "chunk_index")))
    return rows.where("place <= 3").select("article_id", "chunk_id", "place")


@query("status_priority_page", f"WITH {ARTICLES} SELECT article_id, status, year FROM articles ORDER BY CASE status WHEN 'indexed' THEN 0 WHEN 'validated' THEN 1 ELSE 2 END, year DESC, title, article_id LIMIT 40")
def status_priority_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("status") == "indexed", 0).when(F.col("status") == "validated", 1).otherwise(2)
    return articles(spark, sf_dir).orderBy(place, F.desc("year"), "title", "article_id").limit(40).select("article_id", "status", "year")


@query("job_claim_order", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, ts, event_id LIMIT 25")
def job_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.orderBy(F.when(F.col("value") > 50, 0).otherwise(1), "ts", "event_id").limit(25).select("event_id", "user_id")


@query("source_priority_pick", "SELECT l_orderkey, arg_min(l_linenumber, (CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linestatus, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def source_priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(place, "l_linestatus", "l_linenumber")).alias("l_linenumber"))


@query("derived_concepts", "SELECT item_id, list_sort(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), lambda t: {'n': -length(t), 't': t}))[1:3].list_transform(lambda x: x.t)) AS concepts FROM benchmark")
def derived_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest terms of a question, in alphabetical order."""
    terms = F.transform(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(terms), 1, 3), lambda x: x["t"]))
    return table(spark, sf_dir, "benchmark").select("item_id", best.alias("concepts"))


NEAR = 0.9


def diversified(rows: DataFrame, key: str, most: int, strength: float = 0.15) -> DataFrame:
    """Greedy diversification within each ``key``: ``id, base, words`` become ``id, place, adjusted``.

    Each next item has the highest base less ``strength`` times its likeness to the nearest item
    taken; from a likeness of 0.9 on it counts as one. A group is the candidate list of one query,
    cut to a few hundred by the ranking that made it.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = sorted(zip(-pdf["base"], pdf["id"], pdf["words"].map(frozenset)), key=lambda x: x[:2])
        near, out = [0.0] * len(left), []
        while left and len(out) < most:
            i = min(range(len(left)), key=lambda j: (-max(-left[j][0] - strength * near[j], 0.0), left[j][1]))
            base, chosen, words = left.pop(i)
            out.append((pdf[key].iloc[0], chosen, len(out) + 1, max(-base - strength * near.pop(i), 0.0)))
            for j, (_, _, other) in enumerate(left):
                like = len(words & other) / len(words | other) if words and other else 0.0
                near[j] = max(near[j], 1.0 if like >= NEAR else like)
        return pd.DataFrame(out, columns=[key, "id", "place", "adjusted"])

    return rows.groupBy(key).applyInPandas(pick, f"{key} string, id long, place int, adjusted double")


@query("diversified_selection")
def diversified_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the hundred longest articles of each source, ten that differ in words."""
    rows = articles(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "article_id"))).where("rn <= 100")
    rows = rows.select("source", F.col("article_id").alias("id"), (1 / F.col("rn")).alias("base"), F.array_distinct(content_terms(F.col("body"))).alias("words"))
    return diversified(rows, "source", 10)
