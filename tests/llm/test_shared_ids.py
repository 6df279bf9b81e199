"""op3 on several texts without an id, and several of one id, against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from paperloom.llm import substrings


def run(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def removed(rows):
    """rows (doc_id, part, text): as the docstring says, by doc_id (null first), part, then place."""
    several = {d for d, p, _ in rows if len({q for e, q, _ in rows if e == d}) > 1}
    place = lambda d, p, k: (-(2**63) if d is None else d, p if d in several else 0, k)
    seen = {}
    for d, p, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - 19):
            s = " ".join(w[k : k + 20])
            seen[s] = min(seen.get(s, place(d, p, k)), place(d, p, k))
    out = []
    for d, p, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            if seen[" ".join(w[k : k + 20])] < place(d, p, k):
                gone[k : k + 20] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_one_id_on_several_texts(spark):
    long = run(0, 60)
    texts = [
        (None, long), (None, long), (None, run(500, 530)), (None, "short one"), (None, run(900, 1000) + " " + long), (None, long + " " + run(2000, 2040)), (None, None), (None, ""),
        (4, run(3000, 3050)), (4, run(3000, 3050) + " " + long), (4, run(3000, 3050)), (4, "x " + run(900, 960)), (4, "few"), (9, long), (9, long), (12, run(5000, 5030)), (13, "a " + run(5000, 5030)),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = [(r.doc_id, r.part, r.text) for r in df.selectExpr("doc_id", "xxhash64(text) AS part", "text").collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df).collect()]
    assert sorted(got, key=str) == removed(rows)
