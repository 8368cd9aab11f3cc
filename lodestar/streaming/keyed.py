"""Keyed state over the event log: rate limits, leases, cooldowns and reservations that expire.

Each operator keeps what later events can still change and no more, and answers at once: a row that
late events change is given again with a higher ``version``, so that the last version of each row is what
the batch query over the same events says. Events behind the watermark and events that are already known change nothing.
Timers in event time clear keys that fell silent. :func:`replayed` runs one over a stored table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestar.operators.events import LIMITS
from lodestar.plans.registry import ORACLES, query
from lodestar.sources.tables import remember, shared_dir, table

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
#: A lease ends after this gap; a failure keeps its key from being asked again this long (microseconds).
LEASE_GAP, COOLDOWN = 6 * 3600 * SECOND, 12 * 3600 * SECOND


class Keyed(StatefulProcessor):
    """One state value a key, the fresh events of a batch in order, and one timer."""

    state = ""

    def init(self, handle) -> None:
        self.handle, self.value = handle, handle.getValueState("kept", self.state)

    def known(self) -> tuple | None:
        return tuple(self.value.get()) if self.value.exists() else None

    def fresh(self, rows: Iterator[pd.DataFrame], seen: set[int], watermark: int) -> list[tuple[int, int]]:
        """``(time, id)`` of the batch's events that are neither behind the watermark nor seen, in order."""
        new = {}
        for part in rows:
            for at, event in zip(part["us"].tolist(), part["event_id"].tolist(), strict=True):
                if at >= watermark and event not in seen:
                    new.setdefault(event, at)
        return sorted((at, event) for event, at in new.items())

    def wake(self, at: int) -> None:
        """The key's one timer, at a time in microseconds."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class RateLimit(Keyed):
    """Requests of the same key in each half-open window that ends with a request, requests of the same instant included."""

    state = "us array<long>, ids array<long>, version long"
    output = f"user_id long, event_id long, version long, {', '.join(f'in_{s} long' for s, _ in LIMITS)}"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, longest = timerValues.getCurrentWatermarkInMs() * 1000, max(s for s, _ in LIMITS) * SECOND
        us, ids, version = self.known() or ([], [], 0)
        new = self.fresh(rows, set(ids), watermark)
        if not new:
            return
        events = sorted([*zip(us, ids, strict=True), *new])
        at = np.array([t for t, _ in events], np.int64)
        low, high = np.searchsorted(at, [new[0][0], new[-1][0] + longest + 1])
        changed = at[low:high]
        until = np.searchsorted(at, changed, "right")
        counts = {f"in_{s}": until - np.searchsorted(at, changed - (s * SECOND - 1)) for s, _ in LIMITS}
        events_ids = [e for _, e in events]
        yield pd.DataFrame({"user_id": key[0], "event_id": events_ids[low:high], "version": version + 1, **counts})
        # an event at the watermark looks back over the longest window
        first = int(np.searchsorted(at, watermark - longest))
        self.value.update((at[first:].tolist(), events_ids[first:], version + 1))
        self.wake(int(at[-1]) + longest)


class Leases(Keyed):
    """A key's beats in leases that a gap ends, numbered from one; a lease that a late beat joins to the one before is given again with no beats."""

    state = "done long, started array<long>, ended array<long>, beats array<long>, us array<long>, ids array<long>, version long"
    output = "user_id long, session long, version long, beats long, started long, ended long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        done, started, ended, beats, us, ids, version = self.known() or (0, [], [], [], [], [], 0)
        new = self.fresh(rows, set(ids), watermark)
        if not new:
            return
        before, leases = list(zip(started, ended, beats, strict=True)), []
        for s, e, n in sorted([*before, *((at, at, 1) for at, _ in new)]):
            if leases and s - leases[-1][1] <= LEASE_GAP:
                leases[-1] = (leases[-1][0], max(e, leases[-1][1]), leases[-1][2] + n)
            else:
                leases.append((s, e, n))
        lost = [(i, (0, 0, 0)) for i in range(len(leases), len(before))]
        changed = [(i, x) for i, x in enumerate(leases) if i >= len(before) or before[i] != x] + lost
        yield pd.DataFrame([(key[0], done + i + 1, version + 1, n, s, e) for i, (s, e, n) in changed], columns=["user_id", "session", "version", "beats", "started", "ended"])
        over = sum(e < watermark - LEASE_GAP for _, e, _ in leases)
        live = [*((t, i) for t, i in zip(us, ids, strict=True) if t >= watermark), *new]
        kept = leases[over:]
        self.value.update((done + over, *([x[k] for x in kept] for k in range(3)), [t for t, _ in live], [i for _, i in live], version + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())


class Cooldowns(Keyed):
    """The latest time until which a key's failures keep it waiting, their number, and whether it still waits; the end is told when the watermark passes it."""

    state = "retry_at long, failures long, us array<long>, ids array<long>, version long"
    output = "user_id long, version long, retry_at long, failures long, active boolean"

    def row(self, key, version: int, retry_at: int, failures: int, active: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], version, retry_at, failures, active)], columns=["user_id", "version", "retry_at", "failures", "active"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        retry_at, failures, us, ids, version = self.known() or (0, 0, [], [], 0)
        new = self.fresh(rows, set(ids), watermark)
        if not new:
            return
        retry_at, failures = max(retry_at, new[-1][0] + COOLDOWN), failures + len(new)
        live = [*((t, i) for t, i in zip(us, ids, strict=True) if t >= watermark), *new]
        self.value.update((retry_at, failures, [t for t, _ in live], [i for _, i in live], version + 1))
        self.wake(retry_at)
        yield self.row(key, version + 1, retry_at, failures, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        retry_at, failures, _, _, version = self.known()
        self.value.update((retry_at, failures, [], [], version + 1))
        yield self.row(key, version + 1, retry_at, failures, False)


class Reservations(StatefulProcessor):
    """A key's reservations that have not expired, by the clock: each goes by itself ``keep`` milliseconds after it came."""

    output = "user_id long, live long"

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "event_id long", "us long", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for event, at in zip(part["event_id"].tolist(), part["us"].tolist(), strict=True):
                if not self.held.containsKey((event,)):
                    self.held.updateValue((event,), (at,))
        yield pd.DataFrame({"user_id": [key[0]], "live": [sum(1 for _ in self.held.keys())]})

    def close(self) -> None:
        pass


def timed(events: DataFrame, late: str) -> DataFrame:
    """What the operators read of ``events(event_id, user_id, ts)``, with a watermark; rows without a user, an id or a time go."""
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).dropna()
    return rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)


def keyed(events: DataFrame, processor: type[Keyed], late: str = "1 hour") -> DataFrame:
    """The versions that ``processor`` gives of its rows, over a stream of events that come at most ``late`` after the latest one."""
    return timed(events, late).groupBy("user_id").transformWithStateInPandas(processor(), processor.output, "append", "eventTime")


def reservations(events: DataFrame, keep: int = 180 * 60 * 1000) -> DataFrame:
    """``(user_id, live)`` of each user whose reservations a batch brings; they expire ``keep`` milliseconds of the clock after they came."""
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).dropna()
    return rows.groupBy("user_id").transformWithStateInPandas(Reservations(keep), Reservations.output, "append", "processingTime")


def last_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest version for each of ``keys``."""
    others = [c for c in rows.columns if c not in (*keys, "version")]
    last = rows.groupBy(*keys).agg(F.max(F.struct("version", *others)).alias("x"))
    return last.select(*keys, *(F.col(f"x.{c}").alias(c) for c in others))


def collected(stream: DataFrame, label: str) -> DataFrame:
    """Run ``stream`` over what is there, into Parquet in the shared folder, and read that; its state is kept in RocksDB below the same folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    remember(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def replayed(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame], label: str, where: str | None = None) -> DataFrame:
    """The output of ``operator`` over the stored table ``events`` as a stream of its files.

    The table's name is given as a pattern, as a stream's path may be a file only so.
    """
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return collected(operator(rows if where is None else rows.where(where)), label)


#: A stored table's files come in any order: nothing in a replay is late.
ANY_ORDER = "3650 days"
STREAMED = {s: f"count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {s * SECOND - 1} MICROSECONDS PRECEDING AND CURRENT ROW)" for s, _ in LIMITS}


@query("streamed_rate_limit", f"SELECT event_id, {', '.join(f'{x} AS in_{s}' for s, x in STREAMED.items())} FROM (SELECT DISTINCT event_id, user_id, ts FROM events)")
def streamed_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sliding_rate_limit``'s counts as a stream gives them."""
    rows = replayed(spark, sf_dir, lambda e: keyed(e, RateLimit, ANY_ORDER), "rate-limit")
    return last_versions(rows, ["user_id", "event_id"]).drop("user_id")


@query("streamed_leases", ORACLES["lease_sessions"])
def streamed_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lease_sessions`` as a stream gives them."""
    rows = last_versions(replayed(spark, sf_dir, lambda e: keyed(e, Leases, ANY_ORDER), "leases"), ["user_id", "session"]).where("beats > 0")
    return rows.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("streamed_cooldowns", "SELECT user_id, max(ts) + INTERVAL 12 HOUR AS retry_at, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY user_id")
def streamed_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cooldowns`` as a stream gives them."""
    rows = last_versions(replayed(spark, sf_dir, lambda e: keyed(e, Cooldowns, ANY_ORDER), "cooldowns", "event_type = 'error'"), ["user_id"])
    return rows.select("user_id", F.timestamp_micros("retry_at").cast("timestamp_ntz").alias("retry_at"), "failures")
