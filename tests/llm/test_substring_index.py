"""The fingerprint index: sound digests, shared ids, runs that are compacted and read again."""

from __future__ import annotations

import random

from test_shared_ids import removed

from paperloom.llm import substrings
from paperloom.llm.common import save, scratch


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df, **kw).collect()), key=str)


def want(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return removed([(r.doc_id, r.part, r.text) for r in df.selectExpr("doc_id", "xxhash64(text) AS part", "text").collect()])


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_that_polynomials_confuse(spark):
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{same} {thue_morse(1024, 'a', 'b')}"), (2, f"{same} {thue_morse(1024, 'b', 'a')}")]
    assert [r[2] for r in result(spark, rows)] == [0, 0]


def test_one_id_with_texts_of_unlike_length(spark):
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(1, p), (5, " ".join(f"q{i}" for i in range(60)) + " " + p), (5, " ".join(f"r{i}" for i in range(70)))]
    assert result(spark, rows) == want(spark, rows)


def corpus(n, seed=3):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(15, 45))) for _ in range(12)]
    licence = " ".join(f"licence{i}" for i in range(25))
    out = []
    for i in range(n):
        parts = rng.choices(lines, k=rng.randint(0, 4)) + [" ".join(f"x{rng.randint(0, 400)}" for _ in range(rng.randint(0, 30)))]
        rng.shuffle(parts)
        out.append((i, "\t ".join([*parts, licence] if i % 3 else parts)))
    return out + [(n, None), (n + 1, ""), (n + 2, " ".join(["again"] * 90)), (n + 3, "é " * 25), (n + 4, "é\u00a0" * 25)] + out[5:9] + [(None, out[1][1]), (None, out[2][1])]


def test_batches_do_not_change_the_result(spark):
    rows = corpus(60)
    expected = want(spark, rows)
    for batches, fan in ((1, 2), (6, 2), (4, 3)):
        assert result(spark, rows, batches=batches, fan=fan) == expected


def test_an_index_goes_on_from_its_manifest_and_reads_compacted_runs(spark):
    rows = [(i, 0, t) for i, t in corpus(48, 8)[:48]]
    path, found, levels = scratch(spark, "index"), [], []
    texts = save(spark.createDataFrame(rows, "doc long, part long, text string"), "texts")
    for k in range(6):
        index = substrings.FingerprintIndex(spark, path)  # each time from the manifest
        index.compact()
        levels.append(max((r["level"] for r in index.runs), default=-1))
        found += index.batch(texts.where(f"doc div 8 = {k}"), texts.where(f"doc div 8 <= {k}")).collect()
    assert levels[2] == 1 and levels[4] == 2  # merged runs stand in the index when a batch is matched
    gone = {}
    for r in found:
        for at in range(r["at"], r["at"] + r["length"]):
            gone.setdefault(r["doc"], set()).update(range(at, at + 20))
    assert [len(gone.get(i, ())) for i, _, _ in rows] == [r[2] for r in sorted(want(spark, [(i, t) for i, _, t in rows]))]
    substrings.FingerprintIndex(spark, path).drop()


def test_a_lost_batch_leaves_the_index_as_it_was(spark):
    texts = save(spark.createDataFrame([(1, 0, "a b c " * 20), (2, 0, "a b c " * 20)], "doc long, part long, text string"), "texts")
    path = scratch(spark, "index")
    substrings.FingerprintIndex(spark, path).batch(texts.where("doc = 1"), texts.where("doc = 1"))
    lost = substrings.FingerprintIndex(spark, path)
    lost._commit = lambda runs: None
    places = lambda rows: sorted((r["doc"], i) for r in rows.collect() for i in range(r["at"], r["at"] + r["length"]))
    every = [(2, i) for i in range(41)]
    assert places(lost.batch(texts.where("doc = 2"), texts)) == every
    again = substrings.FingerprintIndex(spark, path)
    assert len(again.runs) == 1
    assert places(again.batch(texts.where("doc = 2"), texts)) == every
    again.drop()
