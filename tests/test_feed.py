"""A feed that is pushed into and polled from: whatever fails, each message is read once."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselight.sources import feed
from caselight.streaming.runs import run_once

SCHEMA = "id long, message string"


def segments(path):
    return sorted(os.listdir(f"{path}/segments"))


def test_a_failed_batch_sends_nothing_twice(spark, tmp_path):
    source, path, marks, flag = (str(tmp_path / x) for x in ("in", "feed", "marks", "flag"))
    spark.range(100).select("id", F.concat(F.lit("message "), "id").alias("message")).repartition(4).write.parquet(source)

    def fail_once(batches):
        for batch in batches:
            yield batch
            if not os.path.exists(flag) and (batch["id"] == 77).any():
                raise RuntimeError("a task is lost after it has sent rows")

    stream = spark.readStream.schema(SCHEMA).parquet(source).mapInPandas(fail_once, SCHEMA)
    with pytest.raises(Exception, match="lost after it has sent"):
        feed.push(stream, path, marks)
    assert feed.pushed(spark, path, stream.schema).count() == 0
    open(flag, "w").close()
    feed.push(stream, path, marks)
    assert sorted(r["id"] for r in feed.pushed(spark, path, stream.schema).collect()) == list(range(100))


def test_a_batch_is_published_once(tmp_path):
    folder = feed.Folder(str(tmp_path))
    batch = pa.record_batch({"id": [1, 2]})
    first = folder.write_segment(iter([batch, batch]))
    assert (first.rows, folder.write_segment(iter([batch.slice(0, 0)]))) == (4, feed.Written(None, 0))
    assert folder.publish(0, [first, None, feed.Written(None, 0)])
    again = folder.write_segment(iter([batch]))
    assert not folder.publish(0, [again]) and segments(tmp_path) == [first.name]
    left = folder.write_segment(iter([batch]))
    folder.drop([left, left, None])
    assert segments(tmp_path) == [first.name] and [s.name for s in folder.segments(-1, 0)] == [first.name]
    assert folder.publish(1, []) and folder.manifests() == [0, 1] and folder.segments(0, 1) == []


def test_readers_stand_behind_their_cursor(spark, tmp_path):
    source, path, marks = (str(tmp_path / x) for x in ("in", "feed", "marks"))
    spark.createDataFrame([(1, "a"), (None, None)], SCHEMA).write.parquet(source)
    read = spark.readStream.schema(SCHEMA).parquet(source)
    feed.push(read, path, marks)
    spark.createDataFrame([(3, "c")], SCHEMA).write.mode("append").parquet(source)
    feed.push(read, path, marks)
    assert sorted(map(str, (r["id"] for r in feed.pushed(spark, path, read.schema).collect()))) == ["1", "3", "None"]
    assert [r["message"] for r in run_once(feed.poll(spark, path, read.schema, after=0)).collect()] == ["c"]
    assert [r["id"] for r in feed.pushed(spark, path, read.schema, after=0).collect()] == [3]
    only = feed.pushed(spark, path, read.select("message").schema)
    assert {r["message"] for r in only.collect()} == {"a", "c", None}


def test_an_empty_feed(spark, tmp_path):
    assert feed.pushed(spark, str(tmp_path / "none"), spark.createDataFrame([], SCHEMA).schema).count() == 0
