"""The pipeline's near-copy stage links by fingerprints and by similarity."""

from __future__ import annotations

import random

import corpus_pipeline

from paperloom.llm import simhash, similar


def test_links_of_both_kinds_connect(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=300)
    # one part said over and over: the fingerprint hardly moves, the sets share little
    loop = rng.choices(words, k=31)
    a, b = loop * 200 + base[:60], loop * 200 + base[60:120]
    c = b[:-4] + ["x1", "x2", "x3", "x4"]  # similar to b
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(base[150:])), (5, " ".join(base[150:])), (None, "")], "doc_id long, text string")
    bits = (simhash.fingerprint(" ".join(a).encode(), 5) ^ simhash.fingerprint(" ".join(b).encode(), 5)).bit_count()
    assert bits <= 4
    by_sets = {r.doc_id: r.component_id for r in similar.placed(docs).collect()}
    assert by_sets[1] != by_sets[2] == by_sets[3]
    by_both = {r.doc_id: r.component_id for r in similar.placed_by_both(docs).collect()}
    assert by_both == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, None: None}
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 1, 4]
