"""The fingerprint index leaves no shuffle files behind, and merges its runs without a shuffle."""

from __future__ import annotations

import time

from test_substring_index import corpus, result, want

from paperloom.llm import substrings


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_query_that_needed_them(spark):
    df = spark.createDataFrame(corpus(40), "doc_id long, text string").repartition(3)
    before = shuffles(spark)
    done = substrings.dedup(df)
    for _ in range(50):  # they are removed in the background
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert done.count() == df.count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_windows_of_runs_are_merged_in_their_buckets(spark, monkeypatch):
    plans, compact, write = [], substrings.FingerprintIndex.compact, substrings.FingerprintIndex._write
    state = {"on": False}

    def compacting(self):
        state["on"] = True
        compact(self)
        state["on"] = False

    def written(self, kind, no, rows):
        if state["on"]:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(self, kind, no, rows)

    monkeypatch.setattr(substrings.FingerprintIndex, "compact", compacting)
    monkeypatch.setattr(substrings.FingerprintIndex, "_write", written)
    rows = corpus(50, 9)
    assert result(spark, rows, batches=5) == want(spark, rows)
    assert len(plans) >= 4 and not any("Exchange" in p for p in plans)
