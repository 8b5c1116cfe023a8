"""A feed of messages as a Spark data source: a stream is pushed into it and polled from it behind a cursor.

Tasks write segments; a micro-batch becomes visible by one manifest under its number, which is written
once. Segments of failed or repeated attempts are in no manifest, so no message is read twice, whatever
task or driver starts again. A reader's offset is the number of the last manifest that it has seen, and
each segment is a partition of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "message_feed"
#: Rows that a reader hands on at once.
BATCH_ROWS = 10_000


@dataclass
class Segment(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class Folder:
    """Segments and manifests of a feed, on a local disk or any file system that a URI names."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _at(self, part: str) -> tuple[pafs.FileSystem, str]:
        fs, top = pafs.FileSystem.from_uri(self.path) if ":/" in self.path else (pafs.LocalFileSystem(), self.path)
        return fs, f"{top.rstrip('/')}/{part}"

    def write_segment(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """The rows as one new file; without rows there is none."""
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return Written(None, 0)
        name = f"{uuid.uuid4().hex}.parquet"
        fs, place = self._at(f"segments/{name}")
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        rows = first.num_rows
        with fs.open_output_stream(place) as out, pq.ParquetWriter(out, first.schema) as writer:
            writer.write_batch(first)
            for batch in batches:
                writer.write_batch(batch)
                rows += batch.num_rows
        return Written(name, rows)

    def read_segment(self, name: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
        fs, place = self._at(f"segments/{name}")
        with fs.open_input_file(place) as file:
            yield from pq.ParquetFile(file).iter_batches(BATCH_ROWS, columns=columns)

    def drop(self, written: list[Written | None]) -> None:
        """Files of attempts that do not count; one that is gone already is no error."""
        for w in written:
            if w is not None and w.name is not None:
                fs, place = self._at(f"segments/{w.name}")
                if fs.get_file_info(place).type == pafs.FileType.File:
                    fs.delete_file(place)

    def manifests(self) -> list[int]:
        fs, place = self._at("commits")
        found = fs.get_file_info(pafs.FileSelector(place, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def publish(self, number: int, written: list[Written | None]) -> bool:
        """Makes a batch visible; of a batch that is there already, the new files go and False is returned."""
        fs, place = self._at(f"commits/{number:020d}.json")
        if fs.get_file_info(place).type == pafs.FileType.File:
            self.drop(written)
            return False
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        body = {"segments": [w.name for w in written if w and w.name], "rows": sum(w.rows for w in written if w)}
        whole = f"{place}.{uuid.uuid4().hex}"
        with fs.open_output_stream(whole) as out:
            out.write(json.dumps(body).encode())
        fs.move(whole, place)
        return True

    def segments(self, after: int, to: int) -> list[Segment]:
        out = []
        for number in self.manifests():
            if after < number <= to:
                fs, place = self._at(f"commits/{number:020d}.json")
                with fs.open_input_stream(place) as file:
                    out += [Segment(name) for name in json.loads(file.read())["segments"]]
        return out


class FeedReader(DataSourceReader):
    def __init__(self, folder: Folder, schema: StructType, after: int) -> None:
        self.folder, self.columns, self.after = folder, schema.names, after

    def partitions(self) -> list[InputPartition]:
        return self.folder.segments(self.after, max(self.folder.manifests(), default=-1)) or [Segment("")]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from self.folder.read_segment(partition.name, self.columns)


class FeedStreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder, schema: StructType, after: int) -> None:
        self.folder, self.columns, self.after = folder, schema.names, after

    def initialOffset(self) -> dict:
        return {"commit": self.after}

    def latestOffset(self) -> dict:
        return {"commit": max(self.folder.manifests(), default=self.after)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.folder.segments(start["commit"], end["commit"])

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from self.folder.read_segment(partition.name, self.columns)


class FeedWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.folder.write_segment(iter(iterator))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.folder.publish(batchId, messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.folder.drop(messages)


class MessageFeed(DataSource):
    """Options: path; after, the cursor of a reader (default -1: from the start). A reader names its schema."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _folder(self) -> Folder:
        return Folder(self.options["path"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self._folder(), schema, int(self.options.get("after", -1)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStreamReader(self._folder(), schema, int(self.options.get("after", -1)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return FeedWriter(self._folder())


def push(stream: DataFrame, path: str, marks: str) -> None:
    """All that a stream has goes into the feed; with the same folder of marks, it goes on where it ended."""
    stream.sparkSession.dataSource.register(MessageFeed)
    stream.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def poll(spark: SparkSession, path: str, schema: StructType, after: int = -1) -> DataFrame:
    """The feed behind a cursor as a stream."""
    spark.dataSource.register(MessageFeed)
    return spark.readStream.format(FORMAT).schema(schema).option("path", path).option("after", str(after)).load()


def pushed(spark: SparkSession, path: str, schema: StructType, after: int = -1) -> DataFrame:
    """The feed behind a cursor as it is now."""
    spark.dataSource.register(MessageFeed)
    return spark.read.format(FORMAT).schema(schema).option("path", path).option("after", str(after)).load()
