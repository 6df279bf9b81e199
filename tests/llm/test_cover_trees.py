"""Cover trees hold their invariants, prune where data is clustered, and stay exact past 53 bits."""

from __future__ import annotations

import numpy as np

from paperloom.llm import coversearch as cs


def clustered(rng, clusters=40, each=100, dim=8):
    centres = rng.integers(-400, 400, (clusters, dim))
    return np.concatenate([c + rng.integers(-6, 7, (each, dim)) for c in centres]).astype(float)


def test_children_are_apart_and_cover():
    rng = np.random.default_rng(5)
    for points in (clustered(rng), rng.integers(-50, 50, (500, 3)).astype(float), np.zeros((100, 4))):
        t = cs.CoverTree(points)
        for i in range(len(t.radius)):
            assert np.sqrt(((points[t.rows[i]] - t.centre[i]) ** 2).sum(axis=1)).max() <= t.radius[i] + 1e-9
            kids = t.kids[t.start[i] : t.start[i] + t.many[i]]
            if len(kids):
                assert sorted(np.concatenate([t.rows[c] for c in kids]).tolist()) == sorted(t.rows[i].tolist())
                assert all(t.radius[c] <= t.radius[i] / 2 for c in kids)
                gaps = [np.linalg.norm(t.centre[c] - t.centre[d]) for c in kids for d in kids if c < d]
                assert min(gaps) > t.radius[i] / 2


def test_pairs_are_left_out_on_clustered_data():
    rng = np.random.default_rng(6)
    r = clustered(rng)
    q = r[::20]
    score = q @ r.T
    floor = np.sort(score, axis=1)[:, -21]
    qt, rt = cs.CoverTree(q), cs.CoverTree(r)
    a, b, _ = cs.leaf_pairs(qt, rt, floor, 1e-6)
    scored = sum(len(qt.rows[x]) * len(rt.rows[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert scored < 0.4 * score.size
    kept = np.zeros(score.shape, bool)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        kept[np.ix_(qt.rows[x], rt.rows[y])] = True
    assert kept[score >= floor[:, None]].all()


def test_cells_that_cannot_meet_do_not():
    centres = np.array([[100.0, 0.0], [0.0, 100.0]])
    assert cs.meeting(centres, {0: (1.0, 10), 1: (1.0, 10)}, {0: (1.0, 5000.0), 1: (1.0, 0.0)}) == [(0, 0), (1, 0), (1, 1)]


def brute(rows, every, k):
    out = set()
    whole = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows]
    for i, v in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        best = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), j) for j, w in whole if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_exact_past_53_bits_and_on_clusters(spark):
    rng = np.random.default_rng(7)
    big = [(i, (rng.integers(-9, 10, 3) * 1e7 + rng.random(3)).tolist()) for i in range(60)]
    huge = [(100 + i, (rng.integers(-9, 10, 3) * 1e30).tolist()) for i in range(30)]
    plain = [(i, (v / 64).tolist()) for i, v in enumerate(clustered(rng, 12, 40, 4))]
    for rows, kw in ((big, {}), (huge, {}), (plain, {"block": 64, "group": 10})):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        assert {tuple(r) for r in cs.top_k(df, 20, 7, **kw).collect()} == brute(rows, 20, 7)
