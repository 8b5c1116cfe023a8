"""Tables that are written once to the shared folder and read by many queries."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="caselight-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares, spark.checkpoint.dir.

    Where that is not set, a local session takes a folder of its own; on a cluster it is an
    error, as executors would not see each other's files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    return f"{(top or _own_folder(spark.sparkContext.applicationId)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written to a folder of its own."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, order: list[str], dealt: bool = False) -> DataFrame:
    """The table as written in buckets of a key, sorted within them: joins by the key need no shuffle of it.

    dealt: the rows are in `buckets` partitions of the key already.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, key)  # a file a bucket
    rows.write.bucketBy(buckets, key).sortBy(key, *order).option("path", shared_folder(spark, name)).saveAsTable(table)
    return spark.table(table)
