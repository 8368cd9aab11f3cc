"""Event logs: rate limits, queues, leases, state machines, concurrency, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.plans.registry import query
from lodestar.sources.tables import table

#: Windows of the rate limit: seconds and requests allowed in them.
LIMITS = ((60, 1), (3600, 2), (10800, 4))


def request_ages(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """``rows`` with the number of requests of the same key in each window that ends with the request; windows are half-open."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = rows.withColumn("_us", micros)
    for seconds, _ in LIMITS:
        w = Window.partitionBy(key).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), Window.currentRow)
        rows = rows.withColumn(f"in_{seconds}", F.count(F.lit(1)).over(w))
    return rows.drop("_us")


RANGES = ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {s * 1_000_000 - 1} MICROSECONDS PRECEDING AND CURRENT ROW) AS in_{s}" for s, _ in LIMITS)


@query("sliding_rate_limit", f"SELECT event_id, in_60, in_3600, in_10800, in_60 <= 1 AND in_3600 <= 2 AND in_10800 <= 4 AS allowed FROM (SELECT event_id, {RANGES} FROM events)")
def sliding_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_ages(table(spark, sf_dir, "events"), "user_id", "ts")
    ok = F.lit(True)
    for seconds, most in LIMITS:
        ok = ok & (F.col(f"in_{seconds}") <= most)
    return rows.select("event_id", *[f"in_{s}" for s, _ in LIMITS], ok.alias("allowed"))


@query("expired_reservations", "SELECT user_id, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 180 MINUTE) AS live FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY user_id")
def expired_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations of each user and how many are not yet expired."""
    rows = table(spark, sf_dir, "events").where("ts < TIMESTAMP_NTZ '2024-01-30'")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("ts >= TIMESTAMP_NTZ '2024-01-30' - INTERVAL '180' MINUTE")).alias("live"))


@query("queue_metrics", "SELECT event_type AS state, count(*) AS depth, min(ts) AS oldest, date_diff('second', min(ts), TIMESTAMP '2024-02-01') AS age FROM events GROUP BY event_type")
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("depth"), F.min("ts").alias("oldest"))
    second = F.expr("CAST(unix_seconds(TIMESTAMP '2024-02-01') - unix_seconds(CAST(date_trunc('SECOND', oldest) AS TIMESTAMP)) AS BIGINT)")
    return rows.withColumn("age", second)


#: What may follow what.
ALLOWED = {("view", "click"), ("click", "purchase"), ("click", "view"), ("view", "view"), ("purchase", "view"), ("error", "view"), ("view", "error")}
PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in sorted(ALLOWED))


@query("state_transitions", f"WITH t AS (SELECT event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, state, count(*) AS n, (before, state) IN ({PAIRS}) AS allowed FROM t WHERE before IS NOT NULL GROUP BY before, state")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each state follows each, and whether it may."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("state"), before.alias("before")).where("before IS NOT NULL")
    ok = F.concat_ws(">", "before", "state").isin([f"{a}>{b}" for a, b in sorted(ALLOWED)])
    return pairs.groupBy("before", "state").agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", ok)


@query("lease_sessions", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS beats, min(ts) AS started, max(ts) AS ended FROM s GROUP BY user_id, session")
def lease_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's beats in leases: a gap of more than six hours ends one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", us.alias("us"))
    rows = rows.withColumn("fresh", F.when(F.col("us") - F.lag("us").over(w) <= 6 * 3600 * 1_000_000, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("fresh").over(w))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("beats"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("retry_outcomes", "WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, ts FROM events WHERE event_type = 'error') SELECT user_id, attempt, CASE WHEN attempt = 1 THEN ts + INTERVAL 30 SECOND WHEN attempt = 2 THEN ts + INTERVAL 2 MINUTE END AS retry_at, CASE WHEN attempt <= 2 THEN 'requeued' ELSE 'failed' END AS state FROM a WHERE attempt <= 3")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first failures: two are retried after a longer and longer pause, the third is final."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    rows = rows.withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("attempt <= 3")
    at = F.expr("CASE WHEN attempt = 1 THEN ts + INTERVAL '30' SECOND WHEN attempt = 2 THEN ts + INTERVAL '2' MINUTE END")
    return rows.select("user_id", "attempt", at.alias("retry_at"), F.when(F.col("attempt") <= 2, "requeued").otherwise("failed").alias("state"))


@query("idempotent_enqueue", "SELECT user_id, props, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, props")
def idempotent_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job of each request: the first with its key."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id", "props").agg(F.min("event_id").alias("event_id"))


@query("peak_concurrency", "WITH i AS (SELECT o_custkey % 10 AS lane, o_orderdate AS s, o_orderdate + CAST(o_orderkey % 30 AS INTEGER) * INTERVAL 1 DAY AS e FROM orders), d AS (SELECT lane, s AS t, 1 AS delta FROM i UNION ALL SELECT lane, e, -1 FROM i), g AS (SELECT lane, t, sum(delta) FILTER (delta < 0) AS ends, sum(delta) FILTER (delta > 0) AS starts FROM d GROUP BY lane, t), r AS (SELECT lane, sum(coalesce(ends, 0) + coalesce(starts, 0)) OVER (PARTITION BY lane ORDER BY t) AS running FROM g) SELECT lane, CAST(max(running) AS BIGINT) AS peak FROM r GROUP BY lane")
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most intervals open at once in each lane; ends come before starts at one instant."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("lane"), F.col("o_orderdate").alias("s"), F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 30 AS INT))").alias("e"))
    change = rows.select("lane", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x")).groupBy("lane", F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"))
    running = change.select("lane", F.sum("d").over(Window.partitionBy("lane").orderBy("t")).alias("running"))
    return running.groupBy("lane").agg(F.max("running").alias("peak"))


@query("cooldowns", "SELECT user_id, max(ts) + INTERVAL 12 HOUR AS retry_at, count(*) AS failures, max(ts) + INTERVAL 12 HOUR > TIMESTAMP '2024-01-30' AS active FROM events WHERE event_type = 'error' GROUP BY user_id")
def cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("failures"))
    return rows.select("user_id", F.expr("ts + INTERVAL '12' HOUR").alias("retry_at"), "failures", F.expr("ts + INTERVAL '12' HOUR > TIMESTAMP_NTZ '2024-01-30'").alias("active"))


@query("saturation", "WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice > 250000 AS gain FROM orders), g AS (SELECT *, sum(CASE WHEN gain THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM d) SELECT o_custkey, o_orderkey, count(*) FILTER (NOT gain) OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey) AS without_gain FROM g")
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs since the last gain of each campaign."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 250000).alias("gain"))
    rows = rows.withColumn("island", F.sum(F.col("gain").cast("int")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    n = F.count_if(~F.col("gain")).over(Window.partitionBy("o_custkey", "island").orderBy("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", n.alias("without_gain"))


@query("tumbling_event_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stage_funnel", "SELECT stage, count(*) AS n FROM (SELECT unnest(CASE WHEN value > 50 THEN ['all','priced','high'] WHEN value > 0 THEN ['all','priced'] ELSE ['all'] END) AS stage FROM events) GROUP BY stage")
def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that reach each stage of a selection."""
    v, s = F.col("value"), lambda *x: F.array(*map(F.lit, x))
    stages = F.when(v > 50, s("all", "priced", "high")).when(v > 0, s("all", "priced")).otherwise(s("all"))
    return table(spark, sf_dir, "events").select(F.explode(stages).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
