"""Fill-in-the-middle outputs against a plain version that lists every unit."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import fillmiddle

TEXTS = [
    None, "", "a", "é", "word", "two words", "x1y2", "  lead", "tail  ", "naïve café 12", "日本語 text 😀😀 end", "a<P>b", "<S>", "z<M", "<", "<P", ">" * 7, "a" * 5000, "1 " * 3000, "ab,cd;" * 2000, "\n\r\t\x0b\x00é́ x", "M>S>P>",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(None, "no id here"), (None, "no id here"), (7, "same id"), (7, "same id"), (-3, "minus three"), (2**62, "large id, 2")]


def plain(doc_id: int | None, text: str | None) -> tuple:
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, t
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_the_plain_version_and_goes_back(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, n int, output string")
    made = fillmiddle.rearrange(docs)
    assert sorted(map(tuple, made.collect()), key=str) == sorted((plain(*r) for r in ROWS), key=str)
    back = made.select("doc_id", fillmiddle.restored(made.output, made.form).alias("text")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in ROWS), key=str)
    assert {"plain", "psm", "spm"} == {r.form for r in made.collect()}


def test_empty_table_and_other_markers(spark):
    assert fillmiddle.rearrange(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(i, f"text <P> {i} of some words") for i in range(50)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    made = fillmiddle.rearrange(docs, seed="9", cut=100, suffix_first=50, markers=marks)
    assert {r.form for r in made.collect()} == {"psm", "spm"}
    back = made.select("doc_id", fillmiddle.restored(made.output, made.form, marks).alias("text"))
    assert sorted(back.collect()) == sorted(docs.collect())
    with pytest.raises(ValueError, match="markers"):
        fillmiddle.rearrange(docs, markers=("<P>", "<P>x", "<M>"))
    with pytest.raises(ValueError, match="markers"):
        fillmiddle.rearrange(docs, markers=("aba", "<S>", "<M>"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab1 <é😀\n", max_size=12), min_size=1, max_size=5))
def test_places_of_units(texts):
    import numpy as np

    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    runs = fillmiddle.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    before = 0
    for r, t in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        assert runs.count()[r] == len(units)
        for u in range(len(units) + 1):
            assert runs.code_points(np.array([r]), np.array([u]))[0] == before + len("".join(units[:u]))
        before += len(t)
