"""Signs of life are settled for all jobs of a bucket at once, and as one by one."""

from __future__ import annotations

import random

import numpy as np

from paperloom.streaming import timed


def test_all_at_once_is_as_one_by_one():
    rng = random.Random(6)
    beats = timed.Heartbeats()
    beats.step = None  # not asked for each row
    hour = 3600 * 1_000_000
    for _ in range(200):
        now = rng.randrange(20 * hour)
        states = {j: (0, t, t + beats.after) for j in rng.sample(range(9), rng.randint(0, 6)) for t in [rng.randrange(20 * hour)]}
        rows = sorted((rng.randrange(12), rng.choice([now, now - beats.after, rng.randrange(now + 1)]), i, 1) for i in range(rng.randint(0, 30)))
        rows = np.array(rows, np.int64).reshape(-1, 4)
        after, out = beats.settled(dict(states), rows, now)
        want_after, want = timed.InOrder.settled(timed.Heartbeats(), dict(states), rows, now)
        assert after == want_after
        assert sorted(zip(*(x.tolist() for x in out), strict=True)) == sorted(zip(*want, strict=True))
