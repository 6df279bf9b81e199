"""Toxic passages: every significant one is found, and scores equal a plain version's."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import textvec as tv
from paperloom.llm import toxicity as tx

CALM = [f"calm{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        words = rng.choices(CALM, k=rng.randint(20, 90))
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choices(["vile", "rotten", "filthy", "scum"], k=6)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    return tx.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")), rows


def test_every_significant_passage(spark, model):
    bad = "vile rotten"  # a hundred calm words cost more than what stands on either side
    texts = [f"{bad} " + " ".join(CALM) + f" {bad}", " ".join([*CALM, *CALM, bad, *CALM]), " ".join(CALM), "vile " + " ".join(CALM) + f" filthy scum {bad} end", "", None]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {}
    for r in tx.passages(df, model[0]).orderBy("doc_id", "first").collect():
        got.setdefault(r.doc_id, []).append(r.passage)
    assert got[0] == [bad, bad] and got[1] == [bad] and 2 not in got and 4 not in got and 5 not in got
    assert got[3][-1] == f"filthy scum {bad}"


def plain(model, text):
    tokens = [t.encode() for t in re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    key = lambda t: int(tv.word_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0])
    weight = dict(zip(model.keys.tolist(), model.weight.tolist(), strict=True))
    score, keys = [], []
    for t in tokens:
        own, base = key(t), int(tv.mix(np.array([key(t[: tx.STEM])], np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))[0])
        a, b = weight.get(own, 0.0), weight.get(base, 0.0)
        score.append((a if abs(a) >= abs(b) else b) - tx.DRIFT)
        keys.append(own if abs(a) >= abs(b) else base)
    best = lambda v: max([0.0, *(sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1))])
    found = []
    for _, f, p in tx.segments(np.array(score)):
        once = [-tx.DRIFT if score[i] > 0 and keys[i] in keys[f:i] else score[i] for i in range(f, p)]
        found.append((best(once), f, p, once))
    found.sort(key=lambda x: (-x[0], x[1]))
    seen, both = set(), []
    for s, f, p, once in found:
        both.append((s, best([-tx.DRIFT if v > 0 and keys[f + i] in seen else v for i, v in enumerate(once)])))
        seen |= {keys[f + i] for i, v in enumerate(once) if v > 0}
    sig = lambda s: max(0.0, model.lam * s - model.ln_k - np.log(max(1, len(tokens))))
    x = (np.log1p(max(sig(s) for s, _ in both)), np.log1p(sum(sig(f) for _, f in both))) if both else (0, 0)
    a, b, c = model.curve
    return 1 / (1 + np.exp(-np.clip(a + b * x[0] + c * x[1], -30, 30)))


def test_scores_equal_a_plain_version(model):
    m, rows = model
    texts = [t for _, t, _ in rows[:60]] + [None, "", "...", "vile vile calmak vile", "VILE Éé rotten", "vile " + "calmak " * 60 + "vile rotten " * 3]
    np.testing.assert_allclose(m.scores(pa.array(texts, pa.string())), [plain(m, t) for t in texts], rtol=1e-6)


def test_signed_weights_and_held_out_accuracy(spark, model):
    m, rows = model
    assert m.weight.max() > 0 and len(m.keys) == len(m.weight) == len(set(m.keys.tolist()))
    score = m.scores(pa.array([t for _, t, _ in rows]))
    assert np.mean((score >= 0.5) == np.array([y for _, _, y in rows])) > 0.97


def test_tokens_are_counted_whole(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(CALM, k=50)) for _ in range(30)] + [None, "", CALM[0] * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    held = tx.HELD
    got = df.mapInArrow(tx._count, "stem boolean, h long, n long").where("not stem").groupBy("h").sum("n").count()
    assert got == len({w for t in texts if t for w in t.split()}) and tx.HELD == held
