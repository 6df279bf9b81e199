"""The pipeline on tables without rows, and on rows without texts."""

from __future__ import annotations

import corpus_pipeline
import pytest
from paperloom.llm.common import scratch


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, "en", None, None), (3, "few words", "en", "a", 9)]])
def test_pipeline_of_nothing(spark, rows):
    at = scratch(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    out = corpus_pipeline.run(spark, at).collect()
    # texts without words are one group of copies: of size 0, they are drawn or not
    assert not rows or {r.doc_id for r in out} <= {None, 1, 2, 3} and all(0 <= r.shard < 8 for r in out)
    assert rows or not out
