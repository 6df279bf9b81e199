"""Decontamination of a text that is made of benchmark passages from end to end: its time grows with its length, not its square."""

from __future__ import annotations

import random
import time

from paperloom.llm import decontaminate


def test_long_text_of_passages(spark):
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 9, 40])))) for i in range(400)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def seconds(n: int) -> float:
        parts = []
        while sum(map(len, parts)) < n:
            parts.append(rng.choice(items)[1].split() + ["between"])
        words = [w for p in parts for w in p][:n]
        docs = spark.createDataFrame([(1, " ".join(words)), (2, "clean text")], "doc_id long, text string")
        began = time.time()
        row = decontaminate.hits(docs, bench).collect()
        assert len(row) == 1 and row[0].n_hit > n * 0.8
        return time.time() - began

    seconds(1000)
    assert seconds(80_000) < 4 * max(5.0, seconds(20_000))
