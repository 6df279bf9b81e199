"""The timed form of retries, as a stream."""

from __future__ import annotations

import datetime as dt
import json
import time

from paperloom.streaming import jobs


def test_failures_wait_and_come_up_again(spark, tmp_path):
    steps = {"a": [False, False, True], "b": [False, False, False], "c": [False], "d": [True, True]}
    day = dt.datetime(2024, 1, 1)
    rows = [{"job_id": j, "ts": (day + dt.timedelta(seconds=i)).isoformat(), "ok": ok} for j, oks in steps.items() for i, ok in enumerate(oks)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("job_id string, ts timestamp, ok boolean").json(str(tmp_path / "in"))
    run = jobs.retries(stream).writeStream.format("memory").queryName("retried").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("retried").where("decision = 'retry'").count():
            time.sleep(1)
        got = {}
        for r in spark.table("retried").collect():
            got.setdefault(r.job_id, []).append(r.decision)
    finally:
        run.stop()
    assert got == {"a": ["waiting", "waiting", "succeeded"], "b": ["waiting", "waiting", "dead_lettered"], "c": ["waiting", "retry"], "d": ["succeeded"]}
