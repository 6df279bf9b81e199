"""What the near-copy stage writes follows the rows it reads, not the pairs of a group."""

from __future__ import annotations

import random

import numpy as np
import pytest

from paperloom.llm import similar


@pytest.mark.parametrize("bucket", [64, 1024])
def test_a_group_of_almost_similar_texts_is_no_list_of_pairs(spark, monkeypatch, bucket):
    """16 kinds of ten texts: similar within a kind; between kinds 84 of 108 shingles, which bitmaps mostly allow."""
    rng = random.Random(2)
    base = rng.sample([f"word{i}" for i in range(5000)], 100)
    rows = [(k * 10 + v, " ".join([*base[: 6 * k + 4], f"a{k}x{v}", f"b{k}x{v}", *base[6 * k + 6 :]])) for k in range(16) for v in range(10)]
    written, save = {}, similar.save

    def counted(df, name):
        out = save(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "save", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in similar.placed(docs, bucket=bucket).collect()}
    assert found == {d: d // 10 * 10 for d, _ in rows}
    assert max(written.values()) <= written["met"]


def test_levels_fold_as_bitmaps_do():
    rng = np.random.default_rng(4)
    bits = [rng.bytes(8 * int(w)) for w in rng.choice([1, 2, 4, 8, 16], 40)]
    own, levels = similar._levels(bits)
    for w, (place, folded) in levels.items():
        for i, x in enumerate(bits):
            assert (place[i] < 0) == (own[i] < w)
            if own[i] >= w:
                assert (folded[place[i]] == similar._folded(x, w)).all()
    assert similar._levels([])[1] == {}
