"""A sink of events by topic whose batches become visible as a whole.

Tasks write files of one topic each below ``data``; nobody reads them for being there. A batch becomes visible when the
driver, which has heard from all tasks by then, writes its manifest: one small file that names the batch's files of all
topics. Readers follow the manifests. Files of tasks that were lost or repeated are in none, and a batch whose manifest
is there already is left as it is, so a batch that is written again changes nothing.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

MANIFEST = "batch string, topic string, file string, n bigint"


def _disk(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]  # topic, file, rows


class TopicSink(DataSource):
    """Options: ``path``, and for a batch that is not part of a stream ``batch``, its name."""

    @classmethod
    def name(cls) -> str:
        return "topics"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(self.options["path"], self.options["batch"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"])


class _Files:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator) -> _Written:
        """One file per topic that the task has rows of."""
        import pyarrow.compute as pc
        from pyarrow import parquet

        disk, root = _disk(f"{self.path}/data")
        disk.create_dir(root, recursive=True)
        task, open_files, written = uuid.uuid4().hex, {}, {}
        for batch in iterator:
            for topic in pc.unique(batch["topic"]).to_pylist():
                rows = batch.filter(pc.equal(batch["topic"], topic) if topic is not None else pc.is_null(batch["topic"]))
                if topic not in open_files:
                    name = f"{len(open_files)}-{task}.parquet"
                    open_files[topic] = parquet.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=disk)
                    written[topic] = [name, 0]
                open_files[topic].write_batch(rows)
                written[topic][1] += rows.num_rows
        for file in open_files.values():
            file.close()
        return _Written([(topic, name, n) for topic, (name, n) in written.items()])

    def publish(self, messages, batch: str) -> None:
        """Write the manifest of a batch, unless it is there: then the new files go."""
        disk, root = _disk(f"{self.path}/manifest")
        disk.create_dir(root, recursive=True)
        name = f"{root}/{batch}.json"
        if disk.get_file_info(name).is_file:
            self.discard(messages)
            return
        lines = [{"batch": batch, "topic": t, "file": f, "n": n} for m in messages if m for t, f, n in m.files]
        draft = f"{root}/.{batch}-{uuid.uuid4().hex}"
        with disk.open_output_stream(draft) as out:
            out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        disk.move(draft, name)

    def discard(self, messages) -> None:
        disk, root = _disk(f"{self.path}/data")
        for message in messages:
            for _, file, _ in message.files if message else ():
                if disk.get_file_info(f"{root}/{file}").is_file:
                    disk.delete_file(f"{root}/{file}")


class _BatchWriter(_Files, DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        super().__init__(path)
        self.batch = batch

    def commit(self, messages) -> None:
        self.publish(messages, self.batch)

    def abort(self, messages) -> None:
        self.discard(messages)


class _StreamWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self.publish(messages, f"{batchId:012d}")

    def abort(self, messages, batchId: int) -> None:
        self.discard(messages)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's planning worker gets no shipped packages
    spark.dataSource.register(TopicSink)


def write_batch(events: DataFrame, path: str, batch: str) -> None:
    """Events of all topics as one batch; nothing happens if a batch of that name is there."""
    register(events.sparkSession)
    events.write.format("topics").mode("append").options(path=path, batch=batch).save()


def write_stream(events: DataFrame, path: str, checkpoint: str):
    """Start a stream into the sink; each micro-batch is a batch."""
    register(events.sparkSession)
    return (events.writeStream.format("topics").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, topic, file, n) of all visible files."""
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "[0-9A-Za-z]*.json").json(f"{path}/manifest")


def read(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """The visible events, of one topic if given. The driver holds the names of the files, one per task, batch and topic."""
    listed = manifest(spark, path)
    if topic is not None:
        listed = listed.where(F.col("topic") == topic)
    files = [f"{path}/data/{r.file}" for r in listed.select("file").collect()]
    return spark.read.parquet(*files)
