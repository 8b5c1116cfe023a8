"""A table of rows under keys that several writers may add to: commits that exist wholly or not at all.

A commit is a numbered file that names one folder of rows. It is created only if no file of its
number is there, which the file system decides for one writer; the other one reads what the first
has committed, judges its rows again and tries the next number. Rows that no commit names are not
part of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import content_hash

STATUSES = ("NEW", "IDEMPOTENT", "CONFLICT")


class CommittedTable:
    """Rows of a schema under keys, in a folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str]) -> None:
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit_path(self, number: int):
        return self.path(f"{self.folder}/commits/{number:012d}")

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        top = self.path(f"{self.folder}/commits")
        if not self.fs.exists(top):
            return 0
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(top) if s.getPath().getName().isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of all commits up to a version, by default the last."""
        version = self.version() if version is None else version
        folders = [self._named(n) for n in range(1, version + 1)]
        rows = self.spark.read.schema(self.schema)
        return rows.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _named(self, number: int) -> str:
        stream = self.fs.open(self._commit_path(number))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _create(self, number: int, folder: str) -> bool:
        """Whether the commit is this writer's; False if the number is taken."""
        try:
            stream = self.fs.create(self._commit_path(number), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        try:
            stream.writeUTF(folder)
        finally:
            stream.close()
        return True

    def judged(self, incoming: DataFrame, version: int | None = None) -> DataFrame:
        """Distinct incoming rows with status: NEW, IDEMPOTENT (stored alike), CONFLICT.

        A key is in conflict if other content is stored under it, or if the incoming rows
        themselves hold several contents for it: then all of them are, whatever their order.
        """
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = incoming.select(*columns).distinct()
        rows = rows.withColumn("_own", content_hash(rows, self.key))
        stored = self.read(version)
        known = stored.select(*[F.col(k).alias(f"_{k}") for k in self.key], content_hash(stored, self.key).alias("_stored"))
        contents = rows.groupBy(*[F.col(k).alias(f"_k{k}") for k in self.key]).agg(F.count("*").alias("_n"))
        met = rows.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key], "left").join(contents, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in self.key])
        status = F.when((F.col("_n") > 1) | (F.col("_stored") != F.col("_own")), "CONFLICT").when(F.col("_stored").isNull(), "NEW").otherwise("IDEMPOTENT")
        return met.select(*columns, status.alias("status"))

    def add(self, incoming: DataFrame, tries: int = 20) -> dict[str, int]:
        """Commits the new rows and tells how many rows there were of each status.

        With a conflict nothing is committed. Where another writer was first, the rows are judged
        again against what it has committed.
        """
        for _ in range(tries):
            version = self.version()
            rows = self.judged(incoming, version)
            counts = dict.fromkeys(STATUSES, 0) | {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
            if counts["CONFLICT"] or not counts["NEW"]:
                return counts
            folder = f"{self.folder}/rows/{uuid.uuid4().hex}"
            rows.where("status = 'NEW'").drop("status").write.parquet(folder)
            if self._create(version + 1, folder):
                return counts
        raise TimeoutError(f"another writer was first {tries} times")
