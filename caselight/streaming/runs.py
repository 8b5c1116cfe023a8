"""Running a stream to its end, for equivalence with the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.written import shared_folder


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a file alone is no folder to watch: its parent is, narrowed to its name
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_watched(spark, path))


def _watched(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        return path
    folder = shared_folder(spark, "stream-in")
    spark.read.parquet(path).write.parquet(folder)
    return folder


def run_once(stream: DataFrame, mode: str = "append", state_store: tuple[str, str] | None = None) -> DataFrame:
    """All that is there goes through; the result is read back from the shared folder.

    state_store: a setting that the query is started under.
    """
    spark = stream.sparkSession
    out, marks = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-marks")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    before = spark.conf.get(state_store[0], None) if state_store else None
    if state_store:
        spark.conf.set(*state_store)
    started = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()
    try:
        started.awaitTermination()
    finally:
        if state_store:
            spark.conf.unset(state_store[0]) if before is None else spark.conf.set(state_store[0], before)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(out).select(*stream.columns)
