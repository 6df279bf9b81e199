"""Top-k search and URL verdicts against plain versions; the queries and the pipeline on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from paperloom.llm import coversearch, urlfilter
from paperloom.llm.queries import ORACLE, QUERIES


def brute_top(rows, every, k):
    good = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        exact = lambda b, a=a: min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1)
        best = sorted((-exact(b), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block,group", [(32, 4), (8192, 2048)])
def test_top_k(spark, block, group):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # one very common vector
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (320, [float("inf")] + [0.0] * 5), (None, rows[1][1]), (340, [0.5, 0.5]), (341, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {tuple(r) for r in coversearch.top_k(df, 20, 20, block, group).collect()}
    assert got == brute_top(rows, 20, 20)


def test_top_k_of_large_whole_numbers(spark):
    rows = [(i, [float(10**7 * (i % 7)), float(i)]) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in coversearch.top_k(df, 20, 5).collect()} == brute_top(rows, 20, 5)


def test_top_k_of_nothing(spark):
    assert coversearch.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_host_path_and_rule(spark):
    urls = [
        ("https://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7"), ("http://x.com/en/1", "x.com", "/en/1", "com/en/"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/"), ("ftp://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8"),
        ("http://c.net/de/9", "c.net", "/de/9", "net/de/"), ("http://d.org?x=/es/", "d.org", "", None), ("no scheme.com/en/", "", "", None), (None, "", "", None), ("", "", "", None), ("http://", "", "", None), ("http://e.org/es/#/en/", "e.org", "/es/", "org/es/"), ("http://f.xcom/en/", "f.xcom", "/en/", None),
    ]
    df = spark.createDataFrame([(i, u[0], "<p>tion the</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    verdict = {h + p: v for v, h, p in urlfilter.RULES}
    for i, (_, host, path, rule) in enumerate(urls):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict[rule] if rule else r.verdict) and r.verdict in ("allow", "block")


def best_split(name, known, total):
    """All ways to cut a name, plainly: least cost, and a cut that has it."""
    cost = lambda w: math.log(total / known[w]) if w in known else math.log(max(1, total)) + urlfilter.LETTER * len(w)
    best = [(0.0, ())] + [None] * len(name)
    for j in range(1, len(name) + 1):
        best[j] = min((best[i][0] + cost(name[i:j]), (*best[i][1], name[i:j])) for i in range(j))
    return best[-1], cost


def test_segmentation_is_the_best_split():
    known = {"tion": 50, "the": 90, "re": 30, "there": 20, "in": 40, "a": 5}
    for name in ("thetion", "therein", "tionthere", "xthe", "inarex", "qqqqq", "aaqtheq", "the" * 40 + "tion"):
        (want, _), cost = best_split(name, known, 235)
        got = urlfilter.split(name, known, 235)
        assert "".join(got) == name and sum(map(cost, got)) == pytest.approx(want)
    assert urlfilter.split("thetion", known, 235) == ["the", "tion"]


def plain_verdicts(rows, html):
    """(host, path) -> verdict of naive Bayes over segmented tokens, in plain Python; rows (host, path, ruled)."""
    words = Counter(w for h in html for w in re.findall(r"[^\W\d_]+", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", h or "").lower()))
    total = sum(words.values())

    def tokens(host, path):
        for mark, piece, name in urlfilter.pieces(host, path):
            for w in best_split(piece, words, total)[0][1] if name else [piece]:
                yield mark + w

    of = {k: Counter(t for h, p, v in rows if v == k for t in tokens(h, p)) for k in ("block", "allow")}
    n = Counter(v for _, _, v in rows)
    kinds, odds = len(of["block"] | of["allow"]), {}
    part = lambda k, t: math.log((of[k][t] + 0.5) / (sum(of[k].values()) + 0.5 * kinds))
    for h, p, _ in rows:
        odds[h, p] = math.log(n["block"] / n["allow"]) + sum(part("block", t) - part("allow", t) for t in tokens(h, p))
    return odds


def test_verdicts_equal_a_plain_version(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = [(None, None, None), (7, "http://žlutá-kavárna.cz/" + "thetion" * 60, "<p>žlutá kavárna thetion</p>"), (7, "no scheme", ""), (8, "x://com_a1.the.example.com/en/7", None)]
    df = pages.select("page_id", "url", "html", F.lit(1).alias("host"), F.lit(2).alias("odds")).unionByName(spark.createDataFrame([(*r, 1, 2) for r in extra], "page_id long, url string, html string, host int, odds int"))
    got = urlfilter.judge(df).collect()
    fixed = {h + p: v for v, h, p in urlfilter.RULES}
    want = plain_verdicts([(r.host, r.path, fixed.get(r.rule)) for r in got], [r.html for r in df.collect()])
    assert len(got) == df.count()
    for r in got:
        assert r.odds == pytest.approx(want[r.host, r.path], abs=1e-6)
        assert r.verdict == (fixed[r.rule] if r.rule else "block" if r.odds > 0 else "allow")


def test_no_pages(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE:
        n = pd.read_parquet(f"{sf}/{'pages' if name.startswith('op7') else 'documents'}.parquet").shape[0]
        assert len(got) == n
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE[name]).fetchdf()
    value = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, (int, float, np.number)) and v == int(v) else str(v)
    key = lambda df: sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_pipeline(spark, sf):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline as p

    from test_similar import kept

    from paperloom.llm import decontaminate, mixing, sharding, toxicity
    from paperloom.llm.common import save

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    outs = [docs]
    for name, stage in p.STAGES:
        outs.append(save(stage(spark, outs[-1], sf), name))
    ids = [sorted(r.doc_id for r in o.select("doc_id").collect()) for o in outs]
    assert all(o.columns == docs.columns for o in outs[:-1])
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids[1] == sorted(r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect())
    assert ids[2] == sorted(kept([(r.doc_id, r.text) for r in outs[1].collect()]))
    bad = {bytes(r.key) for r in decontaminate.hits(outs[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[3] == sorted(r.doc_id for r in outs[2].collect() if hashlib.md5(r.text.encode()).digest() not in bad)
    assert ids[4] == sorted(r.doc_id for r in mixing.mix(outs[3]).collect() for _ in range(r.copies))
    last = outs[5].collect()
    assert ids[5] == ids[4]
    shards = {r.doc_id: r.shard for r in sharding.assign(outs[4], p.SHARDS).collect()}
    assert all(shards[r.doc_id] == r.shard for r in last)
    for s in set(shards.values()):
        assert sorted(r.slot for r in last if r.shard == s) == list(range(sum(r.shard == s for r in last)))
