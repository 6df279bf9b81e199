"""Recorded model answers by the content of the request, so that a run can be repeated without asking again."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import storage

#: Names of the models whose answers are recorded ones, or the rules'.
REPLAYED, RULES = "fixture-replay", "fixture-heuristic"


def request_key(schema: Column, system: Column, user: Column) -> Column:
    """What determines an answer, and nothing else: the first 32 digits of a SHA-256."""
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.substring(F.sha2(F.concat(schema, zero, system, zero, user), 256), 1, 32)


class ReplayStore:
    """Answers by request key in the shared folder. A numbered list names the folders that count, in the order of recording; a list is
    written under a number that is not taken, or not at all, so readers and writers side by side see whole recordings."""

    SCHEMA = "request_key string, raw string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _folders(self) -> tuple[int, list[str]]:
        lists = [n for n in storage.names(self.spark, f"{self.path}/lists") if n.isdigit()]
        return (int(lists[-1]), json.loads(storage.get_bytes(self.spark, f"{self.path}/lists/{lists[-1]}"))) if lists else (0, [])

    def record(self, answers: DataFrame) -> None:
        """answers (request_key, raw): each replaces what its key had before; of several in one recording the greatest text counts."""
        folder = uuid.uuid4().hex
        answers.select("request_key", "raw").groupBy("request_key").agg(F.max("raw").alias("raw")).write.parquet(f"{self.path}/{folder}")
        while True:
            n, folders = self._folders()
            if storage.put_new(self.spark, f"{self.path}/lists/{n + 1:08d}", json.dumps([*folders, folder]).encode()):
                return

    def answers(self) -> DataFrame:
        """(request_key, raw): the newest answer of each key."""
        return self._newest(self._folders()[1])

    def _newest(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        each = [self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{f}").withColumn("at", F.lit(i)) for i, f in enumerate(folders)]
        return reduce(DataFrame.unionByName, each).groupBy("request_key").agg(F.max_by("raw", "at").alias("raw"))

    def compact(self) -> None:
        """The newest answers in one folder; what is recorded meanwhile stays behind it."""
        _, old = self._folders()
        folder = uuid.uuid4().hex
        self._newest(old).write.parquet(f"{self.path}/{folder}")
        while True:
            n, now = self._folders()
            if now[: len(old)] != old:
                return  # compacted by another
            if storage.put_new(self.spark, f"{self.path}/lists/{n + 1:08d}", json.dumps([folder, *now[len(old) :]]).encode()):
                return

    def replay(self, requests: DataFrame) -> DataFrame:
        """requests (request_key, ...) with `raw` and `model`; both null where nothing is recorded."""
        known = self.answers().select(F.col("request_key").alias("__key"), "raw")
        return requests.join(known, F.col("request_key") == F.col("__key"), "left").drop("__key").withColumn("model", F.when(F.col("raw").isNotNull(), REPLAYED))
