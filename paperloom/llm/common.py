"""Shared folder handling, lineage cuts and column hygiene for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join at or under this many rows of fixed width may be broadcast (about 16 MB).
BROADCAST_ROWS = 500_000
WS = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and there is one machine (tests), a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by save() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(d)
        p.getFileSystem(conf).delete(p, True)


@contextmanager
def early_cleanup(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the query that needed them ends, not when the driver's garbage is next collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    where, files = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under its name only when it is whole; a name that is taken is an error."""
    where, files = _files(spark, path)
    part, _ = _files(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(where) or not files.rename(part, where):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where the counted size stays under the bound; else Catalyst joins by key."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """A 128-bit content address; null texts share one key."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("\x00null")).cast("binary")))


def n_words(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, WS, -1))).cast("long")
