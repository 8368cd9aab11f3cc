"""Keyed streams over several batches, with late, too late and repeated events, against plain loops."""

from __future__ import annotations

import datetime
import random
import time

import pytest

from lodestar.operators.events import LIMITS
from lodestar.streaming import keyed

SECOND, HOUR = keyed.SECOND, 3600
SCHEMA = "user_id long, event_id long, ts timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def batches(seed: int) -> list[list[tuple]]:
    """Batches of ``(user, event, seconds)``: some come up to an hour late, some much later, some again in a later batch."""
    r, out, number = random.Random(seed), [], 0
    for k in range(7):
        rows = []
        for _ in range(60):
            at = k * 5 * HOUR + r.randrange(5 * HOUR) - r.choice([0, 0, 0, HOUR // 2, 9 * HOUR])
            rows.append((r.randrange(4), number, max(0, at) if r.random() < 0.8 else max(0, at) // 600 * 600))
            number += 1
        rows += r.sample(rows, 5) + (r.sample(out[-1], 8) if out else [])
        out.append(rows)
    return [*out, [(None, 10**6, 5), (1, None, 5)]]


def accepted(parts: list[list[tuple]], late: int) -> list[tuple]:
    """The events that were not behind the watermark when they came, each once."""
    kept, newest, watermark = {}, None, 0
    for rows in parts:
        for user, event, at in rows:
            if user is not None and event is not None and (START.timestamp() + at) > watermark:
                kept.setdefault(event, (user, event, at))
        newest = max([at for user, event, at in rows if user is not None and event is not None] + ([newest] if newest is not None else []))
        watermark = START.timestamp() + newest - late
    return sorted(kept.values())


def streamed(spark, tmp_path, parts, operator):
    for k, rows in enumerate(parts):
        stamped = [(u, e, START + datetime.timedelta(seconds=at)) for u, e, at in rows]
        spark.createDataFrame(stamped, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01 * k)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    return keyed.collected(operator(stream), "test")


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limits_leases_and_cooldowns_are_those_of_the_accepted_events(spark, tmp_path, seed):
    parts = batches(seed)
    late = HOUR
    events = accepted(parts, late)
    assert len({e for p in parts for _, e, _ in p}) - 2 > len(events) > 250
    micros = lambda at: int(START.timestamp() + at) * SECOND
    users = sorted({u for u, *_ in events})

    rows = keyed.last_versions(streamed(spark, tmp_path, parts, lambda s: keyed.keyed(s, keyed.RateLimit, f"{late} seconds")), ["user_id", "event_id"]).collect()
    wanted = {(u, e): [sum(v == u and at - s < other <= at for v, _, other in events) for s, _ in LIMITS] for u, e, at in events}
    assert {(x.user_id, x.event_id): [x[f"in_{s}"] for s, _ in LIMITS] for x in rows} == wanted

    rows = keyed.last_versions(keyed.collected(keyed.keyed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), keyed.Leases, f"{late} seconds"), "test"), ["user_id", "session"]).where("beats > 0").collect()
    wanted = set()
    for user in users:
        times, leases = sorted(at for u, _, at in events if u == user), []
        for at in times:
            if leases and micros(at) - leases[-1][1] <= keyed.LEASE_GAP:
                leases[-1] = [leases[-1][0], micros(at), leases[-1][2] + 1]
            else:
                leases.append([micros(at), micros(at), 1])
        wanted |= {(user, i + 1, s, e, n) for i, (s, e, n) in enumerate(leases)}
    assert {(x.user_id, x.session, x.started, x.ended, x.beats) for x in rows} == wanted

    rows = keyed.last_versions(keyed.collected(keyed.keyed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), keyed.Cooldowns, f"{late} seconds"), "test"), ["user_id"]).collect()
    wanted = {u: (max(micros(at) for v, _, at in events if v == u) + keyed.COOLDOWN, sum(v == u for v, *_ in events)) for u in users}
    assert {x.user_id: (x.retry_at, x.failures) for x in rows} == wanted
    last = max(micros(at) for *_, at in events) - late * SECOND
    assert all(x.active == (x.retry_at > last) for x in rows)


def test_reservations_expire_by_the_clock(spark, tmp_path):
    rows = [(1, 1, START), (1, 2, START), (2, 3, START), (1, 2, START)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKS)

    def run(wanted: int) -> list[tuple]:
        """Run until so many rows are out; by the clock, such a stream never ends by itself."""
        stream = keyed.reservations(source, keep=3000).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", state).start()
        try:
            for _ in range(240):
                time.sleep(0.25)
                if stream.exception():
                    raise stream.exception()
                if (tmp_path / "out" / "_spark_metadata").exists() and len(rows := spark.read.schema("user_id long, live long").parquet(str(tmp_path / "out")).collect()) >= wanted:
                    return sorted((x.user_id, x.live) for x in rows)
            raise AssertionError("no rows")
        finally:
            stream.stop()

    try:
        assert run(2) == [(1, 2), (2, 1)]
        time.sleep(4)
        spark.createDataFrame([(1, 9, START)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert run(3) == [(1, 1), (1, 2), (2, 1)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
