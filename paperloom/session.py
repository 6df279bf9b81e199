"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What the engine relies on: UTC timestamps and runtime re-planning.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword names use _ for dots."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per context: workers need not have it installed."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS) == "10000":  # the default; texts are long, and a batch is held whole on either side
        spark.conf.set(_BATCH_ROWS, "1000")
    if getattr(sc, "_paperloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="paperloom-")) / "paperloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"paperloom/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._paperloom_shipped = True
    return spark


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores, twice as many parts as cores and as many as the table has splits at least; rows of the same keys together.

    A file has no more parts than row groups, whatever its splits: without this, one task may do the work of a whole table. The number is
    given, so small parts are not put together again: the work on a row is large beside the row.
    """
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(n, *keys)
