"""Urls of any length are judged by all of their text."""

from __future__ import annotations

from paperloom.llm import urlfilter

WORDS = {"tion": 50, "the": 90, "there": 20, "re": 30}


def tokens(spark, host, path):
    urls = spark.createDataFrame([(bytearray(b"u"), host, path)], "u binary, host string, path string")
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    return sorted(r.token for r in urlfilter.tokens(urls, words).collect())


def test_words_late_in_a_label_count(spark):
    assert tokens(spark, "the" * 100 + "tion.com", "") == sorted(["t:com", *["h:the"] * 100, "h:tion"])


def test_long_runs_of_a_path_are_segmented(spark):
    assert tokens(spark, "x.com", "/" + "the" * 3000 + "tion") == sorted(["t:com", "h:x", *["p:the"] * 3000, "p:tion"])


def test_words_of_any_length_are_words(spark):
    word = "ab" * 40
    urls = spark.createDataFrame([(bytearray(b"u"), "the" + word + "tion.com", "")], "u binary, host string, path string")
    words = spark.createDataFrame([*WORDS.items(), (word, 3), ("cd" * 300, 5)], "word string, n long")
    assert sorted(r.token for r in urlfilter.tokens(urls, words).collect()) == sorted(["t:com", "h:the", f"h:{word}", "h:tion"])
    pages = spark.createDataFrame([("<p>" + word + " the the</p>",)], "html string")
    assert {r.word: r.n for r in urlfilter.unigrams(pages).collect()} == {word: 1, "the": 2}
