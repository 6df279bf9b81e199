"""Piece models against all segmentations listed one by one, and predictions against texts of known language."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from paperloom.llm import langid
from paperloom.llm.queries import QUERIES

PIECES = ["▁", "▁a", "a", "b", "c", "ab", "bc", "abc", "▁ab", "cab", "é", "▁é", "A", "1", "▁12", "ca", "aa"]


def ways(known, text):
    """Every segmentation of text into numbers of pieces."""
    if not text:
        return [[]]
    number = {p: i for i, p in enumerate(known.pieces) if i}
    out = []
    for k in range(1, len(text) + 1):
        piece = number.get(text[:k], langid.UNKNOWN if k == 1 else None)
        if piece is not None:
            out += [[piece, *rest] for rest in ways(known, text[k:])]
    return out


@pytest.fixture(scope="module")
def known():
    return langid.Pieces(PIECES)


def test_only_letter_pieces_count(known):
    assert known.pieces == ["", *sorted(set(PIECES) - {"1", "▁12"})]


def test_sums_over_all_segmentations(known):
    rng = np.random.default_rng(1)
    p = rng.random((len(known.pieces), 3))
    p /= p.sum(axis=0)
    found = ["", "a", "abc", "abcab", "zé", "aaaa", "abcabcab", "éabz"]
    got = langid.likelihoods(known, found, np.log(p))
    lang, count = np.array([i % 3 for i in range(len(found))]), np.arange(1, len(found) + 1).astype(float)
    want_counts = np.zeros_like(p)
    for i, w in enumerate(found):
        each = [(cut, [math.prod(p[c, k] for c in cut) for k in range(3)]) for cut in ways(known, langid.MARK + w)]
        want = np.log(np.sum([e[1] for e in each], axis=0))
        assert got[i] == pytest.approx(want, abs=1e-9)
        k = lang[i]
        for cut, probability in each:
            for c in cut:
                want_counts[c, k] += count[i] * probability[k] / math.exp(want[k])
    assert langid.expected(known, found, lang, count, np.log(p)) == pytest.approx(want_counts, abs=1e-9)


def test_a_long_word_is_summed_whole(known, monkeypatch):
    p = np.full((len(known.pieces), 1), 1 / len(known.pieces))
    word = "ab" * 3000
    one = langid.expected(known, [word], np.zeros(1, int), np.ones(1), np.log(p))
    monkeypatch.setattr(langid, "LOOKED_UP", 10**6)
    assert langid.expected(known, [word], np.zeros(1, int), np.ones(1), np.log(p)) == pytest.approx(one)
    assert np.isfinite(langid.likelihoods(known, [word], np.log(p))).all()
    assert math.exp(langid.smoothed(one)[:, 0].max()) < 1


WORDS = {"en": "the of and to with was that this which from", "xx": "zka vru plo mno kru sta bly dno hra tma", "日": "日本 語 文字 東京 大学 時間 人間 仕事 学校 電車", "": "ооо ппп ррр ссс ттт ууу ффф ххх ццц ччч"}


def text(rng, lang):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(4, 60)))


@pytest.mark.parametrize("langs", [64, 1, 2])
def test_predictions(spark, langs, monkeypatch):
    monkeypatch.setattr(langid, "LANGS", langs)
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate([*WORDS] * 20)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 34 — !?", "xx"), (903, "²½", "xx"), (904, "the " * 50_000, None), (None, "zka", "xx"), (None, "zka", "xx"), (905, "q" * 20_000, "en"), (906, "OF THE And", "en"), (907, "né" * 3 + "̨", None)]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows + odd], "doc_id long, text string, lang string, score int, best string").repartition(3)
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: r for r in got}
    assert all(found[i].lang_pred == lang and 0.5 < found[i].score <= 1 for i, _, lang in rows)
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (900, 901, 902, 903))
    assert (found[904].lang_pred, found[None].lang_pred, found[906].lang_pred) == ("en", "xx", "en")
    assert found[905].lang_pred in WORDS
    if langs != 64:
        monkeypatch.setattr(langid, "LANGS", 64)
        again = {r.doc_id: r for r in langid.predict(df, langid.train(df)).collect()}
        assert all(r.lang_pred == again[i].lang_pred and r.score == pytest.approx(again[i].score, abs=1e-9) for i, r in found.items())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predict(df, langid.train(df)).collect()] == [(1, "und", 0.0)]
    assert langid.predict(df.limit(0), langid.train(df)).count() == 0


def test_documents_held_out(spark, sf):
    got = QUERIES["op11_language_id"](spark, sf).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").df()
    assert len(got) == len(truth)
    held = got[got.held_out].merge(truth, on="doc_id")
    assert len(held) > 10
    assert (held.lang_pred == held.lang).mean() > 0.97
