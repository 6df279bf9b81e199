"""Short words are summed without logarithms, and give what logarithms give."""

from __future__ import annotations

import numpy as np
import pytest

from paperloom.llm import langid


def test_plain_sums_are_those_of_logarithms(monkeypatch):
    known = langid.Pieces(["▁", "▁a", "a", "b", "ab", "ba", "bab", "é"])
    rng = np.random.default_rng(5)
    logp = np.log(rng.dirichlet(np.ones(len(known.pieces)), 3).T)
    found = ["", "a", "abab", "zébab", "b" * 40, "ab" * 300]
    lang, count = np.array([0, 1, 2, 0, 1, 2]), np.arange(1.0, 7)
    plain = langid.likelihoods(known, found, logp), langid.expected(known, found, lang, count, logp)
    assert langid._plain(logp, 5) and not langid._plain(logp, 601) and not langid._plain(np.full((2, 1), -np.inf), 2)
    monkeypatch.setattr(langid, "_plain", lambda *_: False)
    assert plain[0] == pytest.approx(langid.likelihoods(known, found, logp), abs=1e-9)
    assert plain[1] == pytest.approx(langid.expected(known, found, lang, count, logp), abs=1e-9)


def test_prefixes_are_found_by_bucket():
    pieces = [a + b + c for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    known = langid.Pieces(pieces)
    h = np.array([known._hash(t) for t in [*pieces, "a", "zz", "aiqq"]], np.uint64)
    there, piece = known._found(h)
    assert there.tolist() == [True] * (len(pieces) + 1) + [False] * 2
    assert [known.pieces[i] for i in piece[: len(pieces)]] == pieces and piece[len(pieces) :].tolist() == [-1] * 3
