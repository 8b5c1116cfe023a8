"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as an empty one; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


@lru_cache(maxsize=8)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="caselight-")


def shared_top(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir.

    Where it is not set, a local session, as in tests, takes a folder of its own; on a cluster
    that is an error, as the executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    return _own_folder(spark.sparkContext.applicationId)


def keep_lineage_short(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_top(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that the driver and all executors read."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "written") -> DataFrame:
    """The table as written to the shared folder: without lineage, and without the orders that joins left in its plan."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def file_partitions(df: DataFrame) -> int:
    """How many tasks read this input: a measure of its size that needs no job."""
    return max(1, df.rdd.getNumPartitions())
