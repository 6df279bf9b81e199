"""Text queries against their SQL on texts that the supplied tables lack: blank ones, odd white space, characters that kernels rewrite, long ones."""

from __future__ import annotations

import duckdb
import pytest

from paperloom.plans import registry

ODD = [
    None, "", " ", "\n", "\t", "\r", "\x0b", "\xa0", "　 ", "a", "\n\na", " \n a", "\ta\t", "a \t", "a\n \n \n\n\nb", "a\r\nb\rc", "ﬁne “q” ‘r’ – — −", "x\xa0y z w​",
    "\xa0a \x0b\xa0", " \x0ba\x0b ", "a\x85 b 　c", "", "a", "", "\xa0", "\xa0\n\xa0b\n\xa0",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    long = ["x" * 120_000, "y" * 120_001, "z" * 90_000 + "\n" * 40_000, "\n\n[... document truncated for length ...]\n\n" * 4000]
    rows = [(n * 40 + k, t) for n, t in enumerate(ODD + long) for k in (0, 1, 7)] + [(None, "a"), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    return str(d), con


def same(spark, odd, name: str) -> None:
    d, con = odd
    key = lambda r: tuple(map(repr, r))
    got = sorted(map(tuple, registry.queries()[name](spark, d).collect()), key=key)
    assert got == sorted(con.execute(registry.oracle_sql()[name]).fetchall(), key=key)


def test_long_texts_are_sent_without_their_middle(spark, odd):
    same(spark, odd, "txt09_model_input")


def test_clean_text_on_odd_texts(spark, odd):
    same(spark, odd, "txt01_clean_text")


def test_squeeze_on_odd_texts(spark, odd):
    same(spark, odd, "txt06_squeeze")
