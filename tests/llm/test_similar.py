"""The near-copy stage of the pipeline against all pairs by plain Python."""

from __future__ import annotations

import random

import pytest

from paperloom.llm import similar


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((min((d for d in g if d is not None), default=None) for g in ids.values()), key=str)


@pytest.mark.parametrize("bucket", [8, 8192])
def test_near_copies_from_0_8_go(spark, bucket):
    import corpus_pipeline

    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(2000)]
    line = " ".join(rng.choices(vocab, k=12))
    texts = [None, "", " \t", "one", "One", "one two", "one  two"]
    planted = 0
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(50, 250))
        texts.append(" ".join(base) + " " + line)
        for part in (0.004, 0.01, 0.02, 0.03, 0.05):
            w = [rng.choice(vocab) if rng.random() < part else x for x in base]
            texts.append(" ".join(w) + " " + line)
            a, b = shingles(texts[-1]), shingles(" ".join(base) + " " + line)
            planted += 0.8 <= len(a & b) / len(a | b) <= 0.95
    base = rng.choices(vocab, k=80)
    texts += [" ".join([*base[:i], rng.choice(vocab), *base[i + 1 :]]) for i in range(40)]  # one large group
    assert planted > 20
    rows = [(None if i % 17 == 3 else i, t) for i, t in enumerate(texts)]
    rows += rows[8:12]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id for r in similar.keep_one(df, bucket=bucket).collect()), key=str) == kept(rows)
    if bucket == 8192:
        assert sorted((r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()), key=str) == kept(rows)


def test_nothing_stays_of_nothing(spark):
    assert similar.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_never_differ_in_more_places_than_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 40, 63, 64, 65, 300, 1000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - n // 5], rng.integers(0, 2**63, n // 3, dtype=np.uint64)])
        a, b = similar._bitmaps(np.concatenate([x, y]), np.repeat([0, 1], [n, len(y)]), np.array([n, len(y)]))
        assert similar._apart(a, b) == similar._apart(b, a) <= len(np.setxor1d(x, y)) and similar._apart(a, a) == 0
