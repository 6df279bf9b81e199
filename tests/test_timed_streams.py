"""Timed retries and heartbeats: the same rows however the files are cut and in whatever order they come."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperloom.plans import streams
from paperloom.streaming import timed

DAY = dt.datetime(2024, 1, 1)
DDL = "job_id string, ts timestamp, id long, ok boolean"


def rows(seed):
    rng, out = random.Random(seed), []
    for j in range(6):
        at = 0.0
        for _ in range(40):
            at += rng.choice([0.5, 1, 3, 70, 1500, 2000, 4000])
            out.append((f"j{j}", DAY + dt.timedelta(seconds=at), len(out), rng.random() < 0.3))
    return out


def expected_retries(all_rows, watermark):
    out = []
    for j in {r[0] for r in all_rows}:
        mine = sorted((r[1], r[2], r[3]) for r in all_rows if r[0] == j and r[1] <= watermark)
        n, settled, due = 0, None, None
        for ts, _, ok in mine:
            if due and due < ts:
                out.append((j, "retry", due))
            due = None if n >= 0 else due
            if settled is not None:
                if ts <= settled + dt.timedelta(hours=1):
                    continue
                n, settled = 0, None
            n += 1
            if ok or n == 3:
                out.append((j, "succeeded" if ok else "dead_lettered", ts))
                settled, due = ts, None
            else:
                out.append((j, "waiting", ts))
                due = ts + dt.timedelta(seconds=2 * n)
        if due and due <= watermark:
            out.append((j, "retry", due))
    return sorted(out)


def expected_stale(all_rows, watermark):
    out, after = [], dt.timedelta(seconds=timed.STALE)
    for j in {r[0] for r in all_rows}:
        mine = sorted(r[1] for r in all_rows if r[0] == j and r[1] <= watermark)
        out += [(j, a, a + after) for a, b in zip(mine, [*mine[1:], dt.datetime.max], strict=True) if b > a + after and a + after <= watermark]
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 7])
def test_streams_over_shuffled_files(spark, tmp_path, cuts):
    data = rows(cuts)
    ordered = sorted(data, key=lambda r: r[1])
    rng = random.Random(cuts)
    late = sorted(ordered, key=lambda r: r[1] + dt.timedelta(seconds=rng.random() * 500))  # up to 500 s out of order
    size = -(-len(late) // cuts)
    for i in range(cuts):
        spark.createDataFrame(late[i * size : (i + 1) * size], DDL).coalesce(1).write.parquet(str(tmp_path / f"part-{i:03d}"))
    stream = lambda: spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part-*"))
    watermark = max(r[1] for r in data) - dt.timedelta(minutes=10)
    got = streams.timed_run(spark, timed.retries(stream())).select("job_id", "decision", F.col("at").cast("string")).collect()
    text = lambda t: t.strftime("%Y-%m-%d %H:%M:%S.%f").rstrip("0").rstrip(".")
    assert sorted(map(tuple, got)) == sorted((j, d, text(t)) for j, d, t in expected_retries(data, watermark))
    got = streams.timed_run(spark, timed.stale(stream())).select("job_id", F.col("last").cast("string"), F.col("at").cast("string")).collect()
    assert sorted(map(tuple, got)) == sorted((j, text(a), text(b)) for j, a, b in expected_stale(data, watermark))


def test_a_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "none"))
    assert streams.timed_run(spark, timed.stale(spark.readStream.schema(DDL).parquet(str(tmp_path / "none")))).count() == 0
