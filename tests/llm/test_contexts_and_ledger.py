"""Found identifiers of any shape, spans of long texts, and a ledger that survives what happens twice."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from paperloom.llm import pii, secrets
from paperloom.llm.common import scratch
from paperloom.llm.spans import SPAN, joined


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind.startswith("found_")] for r in pii.personal_data(df).collect()}


def test_identifiers_of_any_shape(spark):
    seeds = [f"please contact user{i}@mail.example.com directly" for i in range(12)]
    more = ["AB-123456", "AB123456", "CZ6508000000192000145399", "555 0199 234", "(555) 0199-234", "john_doe", "x" * 200 + "7"]
    texts = [*seeds, *(f"please contact {m}, directly" if k == 3 else f"please contact {m} directly" for k, m in enumerate(more)), "numbers 0099-7777 elsewhere", "please contact support directly"]
    got = found(spark, texts)
    assert [got[len(seeds) + k] for k in range(len(more))] == [[m] for m in more]
    assert all(not got[i] for i in (*range(len(seeds)), len(texts) - 2, len(texts) - 1))


def test_words_around_a_span_are_whole(spark):
    long = "w" * 500
    seeds = [f"{long} user{i}@mail.example.com then" for i in range(12)]
    got = found(spark, [*seeds, f"{long} QX-4411 then", f"{long[1:]} QX-9911 other"])
    assert got[12] == ["QX-4411"] and not got[13]


def test_many_spans_in_one_text(spark):
    def took(n):
        text = " ".join(f"mail u{i}@mail.example.com or AB-{1000 + i} now" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        row = pii.scan(df).collect()[0]
        assert len(row.base) == n and len(row.marks) == 2 * n
        assert [text[m.start : m.end].lower() for m in row.marks] == [m.instance for m in row.marks]
        assert {(m.before, m.after) for m in row.marks if m.kind_no == 0} == {("mail", "or")}
        return time.time() - t

    took(50)
    one, four = took(4000), took(16000)
    assert four < 9 * one + 2  # in proportion, not with the square


def test_private_keys_run_to_their_end(spark):
    body = "MIIEow\nProc-Type: 4,ENCRYPTED\nAA" * 300
    key = f"-----BEGIN {'LONG ' * 20}RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    login = f"https://{'u' * 90}:{'p' * 400}@host"
    texts = [f"a {key} b {login} c", "-----BEGIN PRIVATE KEY-----\nlost", "1http://a:b@c", "eyJ" + "a" * 9 + "." + "b" * 2000 + "." + "c" * 9, "-----BEGIN PRIVATE KEY-----" * 3000, "a-" * 20000 + "://"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger"))
    ledger.scan(df)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in (r.found or {}).get("more-2", [])] for r in ledger.findings(df).collect()}
    at = texts[0].index(login)
    assert got[0] == [("private_key", 2, 2 + len(key)), ("url_login", at, at + login.index("@") + 1)]
    assert got[1] == [("private_key", 0, 27)] and got[2] == [] and got[3] == [("jwt", 0, len(texts[3]))] and len(got[4]) == 3000 and got[5] == []


def test_a_pair_that_is_recorded_twice_is_read_once(spark):
    df = spark.createDataFrame([(1, "token = abcdefgh12345", 5, "x"), (None, None, 6, "y")], "doc_id long, text string, found int, blob string")
    path = scratch(spark, "ledger")
    one, two = secrets.BlobLedger(spark, path), secrets.BlobLedger(spark, path)
    two.recorded = lambda: spark.createDataFrame([], two.SCHEMA)  # it asked before the first had committed
    assert one.scan(df) == 2 and two.scan(df) == 2
    assert one.recorded().count() == 8 and one.rows().count() == 4 and one.scan(df) == 0
    got = {r.doc_id: (r.blob, [s.kind for s in (r.found or {}).get("base-1", [])]) for r in one.findings(df).collect()}
    assert got == {1: ("x", ["assign"]), None: ("y", [])}


def test_a_scan_that_never_committed_is_not_read(spark):
    df = spark.createDataFrame([(1, "AKIA" + "A" * 16)], "doc_id long, text string")
    path = scratch(spark, "ledger")
    spark.createDataFrame([(b"0", [], "base-1")], secrets.BlobLedger.SCHEMA).write.parquet(f"{path}/scan-lost")
    ledger = secrets.BlobLedger(spark, path)
    assert ledger.recorded().count() == 0 and ledger.scan(df) == 1 and ledger.rows().count() == 2


def test_later_scans_look_at_what_is_new_and_compaction_keeps_it(spark):
    first = spark.createDataFrame([(1, "token = abcdefgh12345"), (2, "nothing")], "doc_id long, text string")
    both = first.unionByName(spark.createDataFrame([(3, "http://me:pw@host"), (4, "nothing"), (5, None)], "doc_id long, text string"))
    path = scratch(spark, "ledger")
    assert secrets.BlobLedger(spark, path, {"base-1": secrets.BASE}).scan(first) == 2
    ledger = secrets.BlobLedger(spark, path)
    due = {tuple(r.due): r["count"] for r in ledger.missing(both).groupBy("due").count().collect()}
    assert due == {("more-2",): 2, ("base-1", "more-2"): 2}  # known texts for the new rules, new texts for all
    assert ledger.scan(both) == 4 and ledger.recorded().count() == 8
    before, at = sorted(map(str, ledger.findings(both).collect())), ledger.recorded()
    ledger.compact()
    assert len(ledger.live()) == 1 and ledger.recorded().count() == 8 == at.count() and ledger.scan(both) == 0
    assert sorted(map(str, ledger.findings(both).collect())) == before
    ledger.compact()
    assert ledger.scan(spark.createDataFrame([(9, "AKIA" + "B" * 16)], "doc_id long, text string")) == 1 and len(ledger.live()) == 2


def plain(text, rules):
    return [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m)]


def test_added_rules_on_whole_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "ftp://me:pw@h http://a:b:c@d"), (-2, "eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM"), (-3, None)], "doc_id long, text string")
    rules = [
        (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:(?:-{0,4}[^-])*-----END [A-Z0-9 ]*PRIVATE KEY-----)?", lambda m: True),
        (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda m: True),
        (r"[A-Za-z0-9+.-]+://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", lambda m: m[0][0].isalpha()),
    ]
    rows = df.unionByName(odd)
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger"))
    ledger.scan(rows)
    more = F.coalesce(F.col("found")["more-2"], F.array().cast(f"array<{SPAN}>"))
    kinds = [r.kind for r in secrets.MORE]
    got = {r.doc_id: r.s for r in ledger.findings(rows).select("doc_id", joined(more).alias("s")).collect()}
    assert got == {r.doc_id: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(plain(r.text, rules))) for r in rows.collect()}
