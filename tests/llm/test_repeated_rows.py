"""Repeated query rows of a search, and null ids beside large ones in a mix."""

from __future__ import annotations

import numpy as np
import pytest

from paperloom.llm import coversearch, mixing

from test_cover_trees import brute


@pytest.mark.parametrize("copies", [1, 2, 3, 5, 30])
def test_a_repeated_query_row_loses_nothing(copies):
    rng = np.random.default_rng(copies)
    r = rng.integers(-60, 60, (499, 6)).astype(float)
    q = rng.integers(-60, 60, (1, 6)).astype(float)
    ids = np.concatenate([np.full(copies, 20), np.arange(1000, 1499)])
    points = np.concatenate([np.repeat(q, copies, axis=0), r])
    got = coversearch.search(np.array([20]), q, np.array([-np.inf]), ids, points, 20)
    want = sorted((-int(x @ q[0]), int(i)) for i, x in zip(ids, points, strict=True) if i != 20)[:20]
    assert [(-s, v) for _, v, s in got] == want


def test_repeated_query_rows_in_a_table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-60, 60, 4) / 64).tolist()) for i in range(120)]
    same = (np.array([50, 50, 50, 50]) / 64).tolist()
    rows += [rows[20], rows[40], rows[40], rows[40]] + [(60, same)] * 30 + [(200 + i, same) for i in range(25)] + [(300, same)] * 12
    rows = [r for r in rows if r[0] != 60 or r[1] == same]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for block in (8, 8192):
        got = sorted(map(tuple, coversearch.top_k(df, 20, 20, block=block).collect()))
        want = []
        whole = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows]
        for i, v in {(i, tuple(v)) for i, v in whole if i % 20 == 0}:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
        assert got == sorted(want)
    assert brute(rows[:10], 20, 3)


def test_null_ids_beside_large_ones(spark):
    big = 2**53
    rows = [(big + 2 * i + 1, f"some words of document {i} " * (1 + i % 3), "s") for i in range(20)] + [(None, "a null id", "s"), (None, "another null id", "s"), (-(2**63), "the least id", "s")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, extra int")
    mixed = mixing.mix(df).collect()
    assert sorted((r.doc_id for r in mixed), key=str) == sorted((r[0] for r in rows), key=str)
    taken = mixing.resample(df).collect()
    assert len(taken) == sum(r.copies for r in mixed) > len(rows)
    assert {(r.doc_id, r.text) for r in taken} <= {(r[0], r[1]) for r in rows}


def test_reruns_pick_the_same_of_alike_rows(spark):
    rows = [(1, "one text of five words", "s", i) for i in range(9)] + [(2, "other", "t", i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    one, two = (sorted(map(tuple, mixing.resample(df.repartition(n)).collect())) for n in (1, 5))
    assert one == two
