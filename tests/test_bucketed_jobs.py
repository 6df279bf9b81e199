"""Timed streams visit the state store once a bucket, not once a job or row."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from paperloom.streaming import timed

MINUTE = 60_000_000


class Store:
    """One value and its timers; counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.trips = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.trips += 1
        return self.value

    def update(self, value):
        self.trips, self.value = self.trips + 1, value

    def clear(self):
        self.trips, self.value = self.trips + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.trips += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.trips += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def run(kind, batches, watermarks):
    """What a bucket gives, as Spark would call it: rows first, then timers up to the watermark."""
    store, processor, out, visits = Store(), kind(), [], 0
    processor.init(store)
    for rows, ms in zip(batches, watermarks, strict=True):
        visits += 1
        if rows:
            out += list(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["job_id", "us", "id", "ok"])]), Clock(ms)))
        for at in sorted(t for t in store.timers if t <= ms):
            visits += 1
            out += list(processor.handleExpiredTimer((0,), Clock(ms), Clock(at)))
            store.timers.discard(at)
        assert len(store.timers) <= 1
    assert store.trips <= 4 * visits
    return sorted((tuple(r) for frame in out for r in frame.astype(object).itertuples(index=False, name=None)), key=str), store


@pytest.mark.parametrize("kind", [timed.Retries, timed.Heartbeats])
def test_jobs_of_a_bucket_do_not_meet(kind):
    rng = random.Random(3)
    rows = [(None if j == 7 else f"j{j}", rng.randrange(300) * MINUTE, 1000 * j + i, rng.random() < 0.3) for j in range(200) for i in range(20)]
    rows.sort(key=lambda r: r[1])
    cut = [rows[i : i + 500] for i in range(0, 4000, 500)] + [[]]
    ends = [0, *(c[-1][1] // 1000 for c in cut[:-2]), 400 * 60_000]
    together, store = run(kind, cut, ends)
    one_by_one = [run(kind, [[r for r in c if r[0] == job] for c in cut], ends)[0] for job in {r[0] for r in rows}]
    assert len(together) > 200
    assert together == sorted((r for each in one_by_one for r in each), key=str)
    assert kind is timed.Retries or store.value is None  # all is settled and forgotten


def test_a_bucket_holds_many_jobs(spark, tmp_path):
    """Each job was a key of its own."""
    spark.range(5000).selectExpr("'j' || id AS job_id", "timestamp_seconds(id) AS ts", "id", "true AS ok").write.parquet(str(tmp_path / "in"))
    stream = timed.stale(spark.readStream.schema("job_id string, ts timestamp, id long, ok boolean").parquet(str(tmp_path / "in")))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for k, v in timed.ROCKS.items():
            spark.conf.set(k, v)
        run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress if p["stateOperators"]) <= 3 * timed.BUCKETS
