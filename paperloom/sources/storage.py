"""Objects and small files under a path that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and there is one machine (tests), a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, whatever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    where, files = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the data files in a folder."""
    where, files = _files(spark, path)
    found = ((f.getPath().getName(), f.getLen()) for f in files.listStatus(where) if f.isFile())
    return sorted((n, size) for n, size in found if not n.startswith(("_", ".")))


def _part(spark: SparkSession, path: str, content: bytes):  # noqa: ANN202
    """The content under a name of its own beside path."""
    part, files = _files(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(part, False)
    out.write(bytearray(content))
    out.close()
    return part


def _renamed(spark: SparkSession, part, path: str, over: bool) -> bool:  # noqa: ANN001
    """Rename in one step, over what is there or not at all; whether it was done. A file system without such a rename is asked first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, files = _files(spark, path)
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if over else kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(part, where, options)
    except Py4JJavaError as e:
        kind = e.java_exception.getClass().getSimpleName()
        if kind == "FileAlreadyExistsException":
            return False
        if kind != "UnsupportedFileSystemException":
            raise
        if files.exists(where) and (not over or not files.delete(where, False)):
            return False
        return files.rename(part, where)
    return True


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small object: written aside, then renamed over what was there, so a reader sees all of the old one or of the new one."""
    if not _renamed(spark, _part(spark, path, content), path, True):
        raise OSError(f"cannot write {path}")


def put_new(spark: SparkSession, path: str, content: bytes) -> bool:
    """One small object under a name that is not taken; False if it is."""
    part = _part(spark, path, content)
    done = _renamed(spark, part, path, False)
    if not done:
        part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, False)
    return done


def write_objects(rows: DataFrame, path: str) -> int:
    """rows (name, content) as files under path, each written by the task that holds its row: aside first, then moved. How many."""
    at = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(at)
        for batch in batches:
            system.create_dir(root, recursive=True)
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def get_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete."""
    where, files = _files(spark, path)
    return files.exists(where) and files.delete(where, True)


def object_key(organization: Column, document: Column, at: Column, kind: str | Column = "original", extension: str | Column = "") -> Column:
    """Fixed shape of keys: org/<organization>/<year>/<month>/<document>/<kind><extension>."""
    kind, extension = (F.lit(x) if isinstance(x, str) else x for x in (kind, extension))
    dotted = F.when((extension == "") | extension.startswith("."), extension).otherwise(F.concat(F.lit("."), extension))
    return F.concat(F.lit("org/"), organization.cast("string"), F.lit("/"), F.date_format(at, "yyyy/MM"), F.lit("/"), document.cast("string"), F.lit("/"), kind, dotted)


class ObjectTable:
    """Objects by key for whole tables of them: put, delete and get are appends and one pass over the keys asked for."""

    SCHEMA = "key string, content binary, content_type string, gone boolean, put long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame) -> None:
        n = len(names(self.spark, self.path))
        rows.withColumn("put", F.lit(n).cast("long")).select("key", "content", "content_type", "gone", "put").write.parquet(f"{self.path}/put-{n:08d}")

    def put(self, objects: DataFrame) -> None:
        """objects (key, content, content_type): each replaces what its key had."""
        self._append(objects.withColumn("gone", F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        self._append(keys.select("key", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("content_type"), F.lit(True).alias("gone")))

    def get(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, content, content_type, size_bytes, checksum_sha256) of the keys asked for that are there, or of all."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/{n}" for n in names(self.spark, self.path)))
        if keys is not None:
            rows = rows.join(keys.select("key").distinct(), "key", "left_semi")
        last = rows.groupBy("key").agg(F.max("put").alias("last"))  # contents stay out of the search for the newest
        rows = rows.join(last, "key").where("put = last and not gone")
        return rows.select("key", "content", "content_type", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("checksum_sha256"))
