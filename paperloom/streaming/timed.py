"""Jobs by the clock of their events: retries that fall due, and heartbeats that stay out.

Rows of a job are taken in the order of their time, whatever order they come in: each waits in state until the watermark has passed it. A
deadline is an event-time timer; it fires once the watermark is past it and nothing came before. So a stream over files at rest ends with
all that its last watermark decides, and gives the same rows however the files are cut into batches.

Needs the RocksDB state store (`ROCKS`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import BASE_DELAY, FORGET, MAX_ATTEMPTS, MAX_DELAY

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Fixed value: buckets that jobs are dealt into; a stream that is taken up again must have as many.
BUCKETS = 1024
#: Fixed value: seconds without a sign of life after which a job is stale.
STALE = 1800
_SECOND = 1_000_000  # times are whole microseconds
_NEVER = 2**63 - 1
_NO_ROWS = np.zeros((0, 3), np.int64)


class InOrder(StatefulProcessor):
    """Feeds each job's rows and deadlines to `step` and `due` in the order of time. Subclasses keep a job's state as a tuple.

    A round trip to the store costs as much as hundreds of rows, and each key takes several, so jobs are kept in buckets: what is known of a bucket is
    one value (names of its jobs, the rows that wait, states, and the timer that is set), read and written once a visit.
    """

    STATE = "timer long, names array<string>, waiting binary, states binary"
    #: waiting: job, time, id, ok; states: job, a, b, whether there is a deadline, deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", self.STATE)

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """The state after a row (time, id, ok), and what it gives; the last of the state is its deadline, or None."""
        raise NotImplementedError

    def due(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        """The same for a deadline that passes."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        jobs: list[str | None] = []
        new = [_NO_ROWS]
        for frame in rows:
            jobs += frame["job_id"].tolist()
            new.append(np.column_stack([frame[c].to_numpy().astype(np.int64) for c in ("us", "id", "ok")]))
        yield from self._advance(jobs, np.concatenate(new), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._advance([], _NO_ROWS, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _job(self, state: tuple | None, ready: list[tuple], now: int) -> tuple[tuple | None, list[tuple]]:
        """A job's state after the rows and the deadlines up to now, and what they give."""
        out: list[tuple] = []
        for row in [*ready, (now + 1,)]:
            while state is not None and state[-1] is not None and state[-1] < row[0]:
                state, said = self.due(state)
                out += said
            if len(row) > 1:
                state, said = self.step(state, row)
                out += said
        return state, out

    def settled(self, states: dict[int, tuple], ready: np.ndarray, now: int) -> tuple[dict[int, tuple], list]:
        """The states after the rows (job, time, id, ok; sorted) and the deadlines up to now, and what they give, by column."""
        job, first = np.unique(ready[:, 0], return_index=True)
        mine = dict(zip(job.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(ready)][: len(first)], strict=True), strict=True))
        out, after = [], {}
        for j in mine.keys() | states.keys():
            i, k = mine.get(j, (0, 0))
            state, said = self._job(states.get(j), ready[i:k, 1:].tolist(), now)
            out += [(j, *r) for r in said]
            if state is not None:
                after[j] = state
        return after, list(zip(*out, strict=True))

    def _advance(self, jobs: list[str | None], new: np.ndarray, watermark: int, fired: int | None = None) -> Iterator[pd.DataFrame]:
        now, known = watermark * 1000, self.bucket.get()
        timer, names, waiting, packed = known if known is not None else (None, [], b"", b"")
        number = {job: j for j, job in enumerate(names)}
        job = np.fromiter((number.setdefault(x, len(number)) for x in jobs), np.int64, len(jobs))
        names = np.array([*number, None], object)[:-1]
        rows = np.concatenate([np.frombuffer(waiting, np.int64).reshape(-1, 4), np.column_stack([job, new])])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        states = {j: (a, b, at if has else None) for j, a, b, has, at in np.frombuffer(packed, np.int64).reshape(-1, 5).tolist()}
        ready = rows[:, 1] <= now
        states, out = self.settled(states, rows[ready], now)
        rest = rows[~ready]
        packed = np.array([(j, a, b, int(at is not None), at or 0) for j, (a, b, at) in states.items()], np.int64).reshape(-1, 5)
        times = [*rest[:, 1].min(initial=_NEVER, keepdims=True).tolist(), *(s[-1] for s in states.values() if s[-1] is not None)]
        wanted = max(watermark + 1, -(-min(times) // 1000)) if min(times) < _NEVER else None
        if timer is not None and timer not in (wanted, fired):  # one that fired is deleted by Spark
            self.handle.deleteTimer(timer)
        if wanted is not None and wanted != timer:
            self.handle.registerTimer(wanted)
        left = np.unique(np.concatenate([rest[:, 0], packed[:, 0]]))
        for some in (rest, packed):
            some[:, 0] = np.searchsorted(left, some[:, 0])
        if len(left):
            self.bucket.update((wanted, names[left].tolist(), rest.tobytes(), packed.tobytes()))
        elif known is not None:
            self.bucket.clear()
        if out and len(out[0]):
            yield pd.DataFrame(dict(zip(self.COLUMNS, [names[np.array(out[0])], *out[1:]], strict=True)))

    def close(self) -> None:
        pass


class Retries(InOrder):
    """State: attempts (-1: settled), time of the last decision, deadline. A failure waits for min(cap, base * 2**(n-1)) seconds; the last one is
    dead-lettered. A settled job is remembered for FORGET, so that a redelivery in that time is a no-op; then its id begins anew."""

    COLUMNS = ["job_id", "attempt", "decision", "us"]

    def step(self, state, row):  # noqa: ANN001, ANN201
        attempts = state[0] if state is not None else 0
        if attempts < 0:
            return state, []
        attempts += 1
        if row[2] or attempts >= MAX_ATTEMPTS:
            return (-1, row[0], row[0] + FORGET * 1000), [(attempts, "succeeded" if row[2] else "dead_lettered", row[0])]
        delay = int(min(MAX_DELAY, BASE_DELAY * 2 ** (attempts - 1)) * _SECOND)
        return (attempts, row[0], row[0] + delay), [(attempts, "waiting", row[0])]

    def due(self, state):  # noqa: ANN001, ANN201
        attempts, _, at = state
        return (None, []) if attempts < 0 else ((attempts, at, None), [(attempts, "retry", at)])


class Heartbeats(InOrder):
    """State: unused, time of the last sign of life, deadline. A job is stale from its deadline until it is heard of again."""

    COLUMNS = ["job_id", "last_us", "us"]
    after = STALE * _SECOND

    def step(self, state, row):  # noqa: ANN001, ANN201
        return (0, row[0], row[0] + self.after), []

    def due(self, state):  # noqa: ANN001, ANN201
        return None, [(state[1], state[2])]

    def settled(self, states, ready, now):  # noqa: ANN001, ANN201
        """As step and due have it, for all jobs at once: a sign of life gives a row if the next one, or now, is past its deadline."""
        job = np.concatenate([np.fromiter(states, np.int64, len(states)), ready[:, 0]])
        us = np.concatenate([np.fromiter((s[1] for s in states.values()), np.int64, len(states)), ready[:, 1]])
        order = np.argsort(job, kind="stable")  # the sign that is known comes first
        job, us = job[order], us[order]
        last = np.append(job[1:] != job[:-1], True)[: len(job)]
        stale = us + self.after < np.where(last, now + 1, np.append(us[1:], 0)[: len(us)])
        after = {j: (0, t, t + self.after) for j, t in zip(job[last & ~stale].tolist(), us[last & ~stale].tolist(), strict=True)}
        return after, [job[stale], us[stale], us[stale] + self.after]


def _run(rows: DataFrame, processor: InOrder, schema: str, late: str) -> DataFrame:
    keyed = rows.withWatermark("ts", late).selectExpr(f"pmod(xxhash64(job_id), {BUCKETS}) AS bucket", "job_id", "ts", "unix_micros(ts) AS us", "id", "ok")
    return keyed.groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")


def retries(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """attempts (job_id, ts, id, ok) -> (job_id, attempt, decision, at): waiting, retry when it falls due, succeeded or dead_lettered."""
    done = _run(attempts, Retries(), "job_id string, attempt long, decision string, us long", late)
    return done.selectExpr("job_id", "attempt", "decision", "timestamp_micros(us) AS at")


def stale(signs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """signs (job_id, ts, id, ok) of life -> (job_id, last, at): jobs not heard of for STALE seconds, and when that was so."""
    done = _run(signs, Heartbeats(), "job_id string, last_us long, us long", late)
    return done.selectExpr("job_id", "timestamp_micros(last_us) AS last", "timestamp_micros(us) AS at")
