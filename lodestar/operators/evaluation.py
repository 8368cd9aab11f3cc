"""Ranking, traceability and calibration metrics; experiments; pairwise comparison."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.retrieval import small
from lodestar.plans.registry import query
from lodestar.sources.tables import stored, table

K = 20


def judged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, id, rank, grade``: each supplier's parts by price, graded by the part's size (2 expected, 1 acceptable)."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("price"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 10, 2).when(F.col("p_size") <= 20, 1).otherwise(0).alias("grade"))
    return line.join(part, "id").withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("price"), "id"))).select("case_id", "id", "rank", "grade")


LISTS = "j AS (SELECT case_id, id, grade, row_number() OVER (PARTITION BY case_id ORDER BY price DESC, id) AS rank FROM (SELECT l_suppkey AS case_id, l_partkey AS id, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2) JOIN (SELECT p_partkey AS id, CASE WHEN p_size <= 10 THEN 2 WHEN p_size <= 20 THEN 1 ELSE 0 END AS grade FROM part) USING (id))"


def ranking_metrics(lists: DataFrame, k: int = K) -> DataFrame:
    """Precision, recall, reciprocal rank and graded nDCG at ``k`` of ``lists(case_id, rank, grade)``; precision is always over ``k``."""
    inside = F.col("rank") <= k
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "rank"))
    own = lists.withColumn("ideal", ideal).groupBy("case_id").agg(
        (F.count_if(inside & (F.col("grade") > 0)) / k).alias("precision"),
        (F.count_if(inside & (F.col("grade") == 2)) / F.nullif(F.count_if(F.col("grade") == 2), F.lit(0))).alias("recall"),
        F.coalesce(1 / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(inside, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1)).otherwise(0.0)).alias("idcg"),
    )
    return own.select("case_id", "precision", "recall", "mrr", F.coalesce(F.col("dcg") / F.nullif("idcg", F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


METRICS = f"""WITH {LISTS}, i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, rank) AS ideal FROM j), m AS (SELECT case_id,
 count(*) FILTER (rank <= 20 AND grade > 0) / 20 AS precision, count(*) FILTER (rank <= 20 AND grade = 2) / nullif(count(*) FILTER (grade = 2), 0) AS recall,
 coalesce(1.0::DOUBLE / min(CASE WHEN grade > 0 THEN rank END), 0) AS mrr, sum(CASE WHEN rank <= 20 THEN (2.0::DOUBLE ^ grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
 sum(CASE WHEN ideal <= 20 THEN (2.0::DOUBLE ^ grade - 1) / log2(ideal + 1) ELSE 0 END) AS idcg FROM i GROUP BY case_id),
 r AS (SELECT case_id, precision, recall, mrr, coalesce(dcg / nullif(idcg, 0), 0) AS ndcg FROM m)"""


@query("ranking_metrics", METRICS + " SELECT case_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM r")
def ranking_metrics_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ranking_metrics(judged_lists(spark, sf_dir))
    return m.select("case_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query("mean_ranking_metrics", METRICS + " SELECT count(*) AS cases, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM r")
def mean_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ranking_metrics(judged_lists(spark, sf_dir))
    return m.agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query("promotion_gate", METRICS + ", a AS (SELECT avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM r), u AS (SELECT 'recall' AS metric, recall AS value, 0.9 AS floor FROM a UNION ALL SELECT 'mrr', mrr, 0.75 FROM a UNION ALL SELECT 'ndcg', ndcg, 0.8 FROM a) SELECT metric, round(value, 6) AS value, value >= floor AS passed FROM u")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics against their floors."""
    m = ranking_metrics(judged_lists(spark, sf_dir)).agg(*[F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")])
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(x).alias("floor")) for c, x in (("recall", 0.9), ("mrr", 0.75), ("ndcg", 0.8))])).alias("x"))
    return long.select("x.metric", F.round("x.value", 6).alias("value"), (F.col("x.value") >= F.col("x.floor")).alias("passed"))


@query("traceability", "WITH s AS (SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey), t AS (SELECT o_orderkey, count(l_partkey) AS cited, count(*) FILTER (p_partkey IS NOT NULL) AS traced FROM s LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 30) p ON p.p_partkey = s.l_partkey GROUP BY o_orderkey) SELECT count(*) AS statements, count(*) FILTER (cited = 0) AS unsupported, CAST(sum(cited) AS BIGINT) AS citations, CAST(sum(traced) AS BIGINT) AS traced, round(sum(traced) / nullif(sum(cited), 0), 6) AS share FROM t")
def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, their citations, and how many of those lead to admitted evidence; sums first, then the share."""
    allowed = table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("ok"))
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(allowed, "l_partkey", "left")
    own = cited.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_partkey").alias("cited"), F.count("ok").alias("traced"))
    every = table(spark, sf_dir, "orders").select("o_orderkey").join(own, "o_orderkey", "left").na.fill(0)
    total = every.agg(F.count(F.lit(1)).alias("statements"), F.count_if(F.col("cited") == 0).alias("unsupported"), F.sum("cited").alias("citations"), F.sum("traced").alias("traced"))
    return total.withColumn("share", F.round(F.col("traced") / F.nullif("citations", F.lit(0)), 6))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score, relevant``: documents with a label, scored by the share of long words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(F.regexp_count("text", F.lit("[a-z]{9,}")) / (1 + F.regexp_count("text", F.lit(r"\S+"))), 3).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("score", (F.col("quality") == 1).alias("relevant"))


OBSERVED = "o AS (SELECT round(len(regexp_extract_all(text, '[a-z]{9,}')) / (1 + len(regexp_extract_all(text, '\\S+'))), 3) AS score, quality = 1 AS relevant FROM labels JOIN documents USING (doc_id))"
SWEEP = f"""WITH {OBSERVED}, g AS (SELECT score AS threshold, count(*) AS n, count(*) FILTER (relevant) AS pos FROM o GROUP BY score), t AS (SELECT sum(n) AS n, sum(pos) AS pos FROM g),
 c AS (SELECT threshold, sum(n) OVER (ORDER BY threshold DESC) AS taken, sum(g.pos) OVER (ORDER BY threshold DESC) AS tp FROM g),
 m AS (SELECT threshold, coalesce(tp / nullif(taken, 0), 0) AS precision, coalesce(tp / nullif(t.pos, 0), 0) AS recall, coalesce((t.n - t.pos - taken + tp) / nullif(t.n - t.pos, 0), 0) AS specificity FROM c, t),
 f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)"""


RANGES = 64


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """Precision, recall, specificity and F1 for each threshold ``score >= threshold`` of ``rows(score, relevant)``.

    Scores are counted first, so the running sums go over distinct scores only. Those are dealt into ``RANGES`` ranges at
    quantiles; a range's sums start from those of the ranges above it.
    """
    counts = rows.groupBy(F.col("score").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.count_if("relevant").alias("pos"))
    total = counts.agg(F.sum("n").alias("N"), F.sum("pos").alias("P"))
    cuts = counts.agg(F.percentile_approx("threshold", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    counts = counts.withColumn("part", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c <= F.col("threshold"))))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos0"))
    w = Window.partitionBy("part").orderBy(F.desc("threshold"))
    run = counts.join(F.broadcast(parts), "part").select("threshold", (F.col("n0") + F.sum("n").over(w)).alias("taken"), (F.col("pos0") + F.sum("pos").over(w)).alias("tp")).join(F.broadcast(total))
    zero = F.lit(0)
    m = run.select(
        "threshold",
        F.coalesce(F.col("tp") / F.nullif("taken", zero), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif("P", zero), F.lit(0.0)).alias("recall"),
        F.coalesce((F.col("N") - F.col("P") - F.col("taken") + F.col("tp")) / F.nullif(F.col("N") - F.col("P"), zero), F.lit(0.0)).alias("specificity"),
    )
    both = F.col("precision") + F.col("recall")
    return m.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


@query("threshold_sweep", SWEEP + " SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1 FROM f")
def threshold_sweep_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_sweep(observations(spark, sf_dir)).select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "f1")])


@query("calibrated_threshold", SWEEP + " SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY round(f.f1, 12) DESC, round(precision, 12) DESC, round(specificity, 12) DESC, threshold DESC LIMIT 1")
def calibrated_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = threshold_sweep(observations(spark, sf_dir)).orderBy(*[F.desc(F.round(c, 12)) for c in ("f1", "precision", "specificity")], F.desc("threshold"))
    return best.limit(1).select("threshold", F.round("f1", 6).alias("f1"))


@query("confusion_at_threshold", f"WITH {OBSERVED} SELECT count(*) FILTER (score >= 0.2 AND relevant) AS tp, count(*) FILTER (score >= 0.2 AND NOT relevant) AS fp, count(*) FILTER (score < 0.2 AND relevant) AS fn, count(*) FILTER (score < 0.2 AND NOT relevant) AS tn, round(avg((score - CASE WHEN relevant THEN 1 ELSE 0 END) ^ 2), 6) AS brier FROM o")
def confusion_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = F.col("score") >= 0.2, F.col("relevant")
    return observations(spark, sf_dir).agg(F.count_if(s & r).alias("tp"), F.count_if(s & ~r).alias("fp"), F.count_if(~s & r).alias("fn"), F.count_if(~s & ~r).alias("tn"), F.round(F.avg(F.pow(F.col("score") - r.cast("int"), F.lit(2))), 6).alias("brier"))


@query("variant_deltas", "WITH m AS (SELECT l_returnflag AS variant, avg(l_extendedprice) AS price, avg(l_discount) AS discount FROM lineitem GROUP BY 1), u AS (SELECT variant, 'price' AS metric, price AS value FROM m UNION ALL SELECT variant, 'discount', discount FROM m) SELECT u.variant, u.metric, round(u.value - b.value, 6) AS delta FROM u JOIN u b ON b.metric = u.metric AND b.variant = 'N' WHERE u.variant <> 'N'")
def variant_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant's metrics less the baseline's."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variant")).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))
    long = means.unpivot("variant", ["price", "discount"], "metric", "value")
    base = long.where("variant = 'N'").select("metric", F.col("value").alias("base"))
    return long.where("variant <> 'N'").join(base, "metric").select("variant", "metric", F.round(F.col("value") - F.col("base"), 6).alias("delta"))


# Resamples, and the seed.
SAMPLES, SEED = 2000, 1729


def bootstrap(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``mean, low, high``: the mean of ``rows(x)`` and its 95 % interval over ``samples`` resamples.

    A row's weight in a resample is drawn from a Poisson distribution, so the weight of equal values together is a Poisson number about their count:
    values are counted first, and each draws all its weights at once, from a generator that its own bits seed. Only sums by resample are
    shuffled. A single row gives its value three times; no row gives nulls. Nulls are left out.
    """

    def run(batches):
        sums, counts = np.zeros(samples), np.zeros(samples)
        for batch in batches:
            for x, n in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                w = np.random.Generator(np.random.Philox(key=[SEED, int(np.float64(x).view(np.uint64))])).poisson(n, samples)
                sums += w * x
                counts += w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), pa.array(sums), pa.array(counts)], ["b", "s", "n"])

    held = rows.select(F.col("x").cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    means = held.mapInArrow(run, "b long, s double, n double").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    ends = means.agg(F.array_sort(F.collect_list("m")).alias("m"))
    at = lambda q: F.get("m", (q * (F.size("m") - 1)).cast("int"))
    mean = held.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("rows"))
    found = ends.select("m").join(F.broadcast(mean))
    return found.select("mean", F.when(F.col("rows") == 1, F.col("mean")).otherwise(at(0.025)).alias("low"), F.when(F.col("rows") == 1, F.col("mean")).otherwise(at(0.975)).alias("high"))


@query("bootstrap_mean")
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap(table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x")))


# --- experiments ---------------------------------------------------------------------------------


@query("rate_between_ends", "WITH g AS (SELECT l_suppkey, l_returnflag, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS a, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS b, min(l_shipdate) AS t0, max(l_shipdate) AS t1 FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(avg((b - a) / date_diff('day', t0, t1)), 5) AS rate, count(*) AS series FROM g WHERE t1 > t0 GROUP BY l_suppkey")
def rate_between_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change per day from the first to the last point of each series, averaged by sample; series without duration are left out."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    ends = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min_by("l_extendedprice", order).alias("a"), F.max_by("l_extendedprice", order).alias("b"), F.min("l_shipdate").alias("t0"), F.max("l_shipdate").alias("t1"))
    rate = (F.col("b") - F.col("a")) / F.date_diff("t1", "t0")
    return ends.where("t1 > t0").groupBy("l_suppkey").agg(F.round(F.avg(rate), 5).alias("rate"), F.count(F.lit(1)).alias("series"))


@query("unit_normalised_means", "SELECT p_brand, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity / 1000 ELSE l_quantity END), 6) AS mean, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def unit_normalised_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity") / 1000).otherwise(F.col("l_quantity")).alias("x"))
    return line.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.round(F.avg("x"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("scaled_scores", "SELECT p_type, round(avg((l_quantity - 1) / 49), 6) AS mean, count(DISTINCT l_suppkey) AS assessors, count(DISTINCT l_suppkey) < 2 AS too_few FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type")
def scaled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", ((F.col("l_quantity") - 1) / 49).alias("x"))
    own = line.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey").groupBy("p_type").agg(F.round(F.avg("x"), 6).alias("mean"), F.countDistinct("l_suppkey").alias("assessors"))
    return own.withColumn("too_few", F.col("assessors") < 2)


@query("trajectory_consensus", "WITH m AS (SELECT c_nationkey AS run, c_mktsegment AS metric, avg(c_acctbal) AS value FROM customer GROUP BY 1, 2), n AS (SELECT count(DISTINCT run) AS runs FROM m) SELECT metric, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high, round(stddev_pop(value), 4) AS spread FROM m, n GROUP BY metric, runs HAVING count(*) = runs")
def trajectory_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that every run has, with mean, range and population deviation over the runs."""
    m = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("run"), F.col("c_mktsegment").alias("metric")).agg(F.avg("c_acctbal").alias("value"))
    runs = m.agg(F.countDistinct("run").alias("runs"))
    own = m.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), F.round(F.stddev_pop("value"), 4).alias("spread"), F.count(F.lit(1)).alias("n"))
    return own.join(F.broadcast(runs), own["n"] == runs["runs"]).drop("n", "runs")


@query("tolerance_scoring", "SELECT o_orderstatus, round(avg(CASE WHEN abs(o_totalprice - s) <= greatest(1e-9 * greatest(abs(o_totalprice), abs(s)), 50000) THEN 1 ELSE 0 END), 6) AS accuracy, count(*) FILTER (s IS NULL) AS failures FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def tolerance_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of observed totals within a tolerance of the truth, and how many are missing."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    both = table(spark, sf_dir, "orders").join(seen, "o_orderkey", "left")
    close = F.abs(F.col("o_totalprice") - F.col("s")) <= F.greatest(1e-9 * F.greatest(F.abs("o_totalprice"), F.abs("s")), F.lit(50000.0))
    return both.groupBy("o_orderstatus").agg(F.round(F.avg(F.when(close, 1).otherwise(0)), 6).alias("accuracy"), F.count_if(F.col("s").isNull()).alias("failures"))


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``left_id, right_id, winner_id``: suppliers that share an order, the dearer line wins; neighbours by line number meet."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    met = line.select(F.col("l_suppkey").alias("left_id"), F.lead("l_suppkey").over(w).alias("right_id"), "l_extendedprice", F.lead("l_extendedprice").over(w).alias("other"))
    return met.where("right_id IS NOT NULL AND left_id <> right_id").select("left_id", "right_id", F.when(F.col("l_extendedprice") >= F.col("other"), F.col("left_id")).otherwise(F.col("right_id")).alias("winner_id"))


@query("pair_concordance", "WITH c AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER w AS b, l_extendedprice AS x, lead(l_extendedprice) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)), p AS (SELECT least(a, b) AS low, greatest(a, b) AS high, CASE WHEN x >= y THEN a ELSE b END AS winner, a AS first FROM c WHERE b IS NOT NULL AND a <> b) SELECT low, high, count(*) AS n, round(avg(CASE WHEN winner = low THEN 1 ELSE 0 END), 6) AS low_share, round(avg(CASE WHEN winner = first THEN 1 ELSE 0 END), 6) AS first_share FROM p GROUP BY low, high")
def pair_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair: comparisons, how often the lower id wins, and how often the one named first."""
    c = comparisons(spark, sf_dir)
    keyed = c.select(F.least("left_id", "right_id").alias("low"), F.greatest("left_id", "right_id").alias("high"), "winner_id", "left_id")
    return keyed.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("winner_id") == F.col("low")).cast("int")), 6).alias("low_share"), F.round(F.avg((F.col("winner_id") == F.col("left_id")).cast("int")), 6).alias("first_share"))


# Rounds at most, and the change of a strength's logarithm that ends them.
ROUNDS, TOLERANCE = 200, 1e-10
#: Rounds between two tests of the change; each round is written to the shared folder.
STRIDE = 5


def bradley_terry(games: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``id, ability, error``: Bradley-Terry strengths of ``games(left_id, right_id, winner_id)`` by minorisation-maximisation.

    Games are summed to pairs once and lie by player. In each round the strengths go to the pairs, if they are few enough to be sent to every task, and the sums
    by player are made where they lie; so no pair is shuffled again. Half a win each way is added to every pair; strengths are scaled to a geometric mean of one. Rounds go on until no strength changes
    any more, ``rounds`` at most.
    """
    low, high = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    pairs = games.groupBy(low.alias("i"), high.alias("j")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("winner_id") == low).alias("w"))
    both = pairs.select("i", "j", (F.col("n") + 1).alias("n"), (F.col("w") + 0.5).alias("w")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("n") + 1).alias("n"), (F.col("n") - F.col("w") + 0.5).alias("w")))
    both = stored(both.repartition("i"), "pairs")
    wins = stored(both.groupBy("i").agg(F.sum("w").alias("wins"), F.sum("n").alias("games")), "wins")
    players = wins.count()
    strength, done, change = wins.select("i", F.lit(1.0).alias("p")), 0, math.inf
    while done < rounds and change > TOLERANCE:
        new = strength
        for _ in range(min(STRIDE, rounds - done)):
            other = new.select(F.col("i").alias("j"), F.col("p").alias("q"))
            base = both.join(small(new, players), "i").join(small(other, players), "j").groupBy("i").agg(F.sum(F.col("n") / (F.col("p") + F.col("q"))).alias("d"))
            new = stored(base.join(wins, "i").select("i", (F.col("wins") / F.col("d")).alias("p")), "round")
            done += 1
        scale = new.agg(F.exp(F.avg(F.ln("p"))).alias("g"))
        new = stored(new.join(F.broadcast(scale)).select("i", (F.col("p") / F.col("g")).alias("p")), "strengths")
        change = new.join(strength.withColumnRenamed("p", "q"), "i").agg(F.max(F.abs(F.ln("p") - F.ln("q")))).first()[0] or 0.0
        strength = new
    return strength.join(wins, "i").select(F.col("i").alias("id"), F.ln("p").alias("ability"), (1 / F.sqrt("games")).alias("error"))


@query("bradley_terry_strengths")
def bradley_terry_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry(comparisons(spark, sf_dir))
