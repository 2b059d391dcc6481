"""A stream whose batches hold at most a given number of messages, whatever the size of the files.

Spark's file source counts files. This source counts rows: an offset is a place in a folder of Parquet files (file and
row), and each batch ends at most ``max_rows`` rows after the last. A batch is read in ranges of rows by as many tasks.

A range in the middle of a row group is reached by decoding what lies before it. So that this is not done again for each
batch, a Python worker that has read up to a place keeps the file open there and goes on from it.

A batch costs Spark some tenths of a second however small it is, so one query alone takes in only so many rows a second.
Several queries, the lanes, share a folder: of the batches of ``max_rows`` rows the first lane takes the first, the second
the second, and so on in turn. Each lane has a batch at work and a checkpoint of its own, so that as many batches as there
are lanes are in flight at most.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _disk(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _file(path: str):
    from pyarrow.parquet import ParquetFile

    disk, name = _disk(path)
    return ParquetFile(disk.open_input_file(name), buffer_size=1 << 20)


KEPT = 16
PLACES: list[tuple[tuple, _Place]] = []


def _places() -> list[tuple[tuple, _Place]]:
    """The places this worker keeps. This module's functions are sent by value, so its own names last for one task only."""
    try:
        from tabloom.streaming import intake
    except ImportError:  # a worker without the package reads each range from the start of its row group
        return []
    return intake.PLACES


class _Place:
    """A file read forwards; ``at`` is the next row."""

    def __init__(self, path: str, columns: list[str]):
        self.file, self.columns, self.at = _file(path), columns, 0
        meta = self.file.metadata
        sizes = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
        self.ends = [sum(sizes[: g + 1]) for g in range(len(sizes))]
        self.group, self.batches, self.rest = -1, iter(()), None

    def rows(self, first: int, stop: int):
        """The rows from ``first`` on up to ``stop``; ``first`` is not before ``at``."""
        while self.at < stop:
            if self.rest is None:
                self._next(first)
            batch, self.rest = self.rest, None
            begin, end = max(first - self.at, 0), min(stop - self.at, batch.num_rows)
            if end < batch.num_rows and begin < batch.num_rows:
                self.rest = batch.slice(end)
                self.at += end
            else:
                self.at += batch.num_rows
            if end > begin:
                yield batch.slice(begin, end - begin).select(self.columns)

    def _next(self, first: int) -> None:
        """The next rows, from the row group that holds ``first`` if that is a later one."""
        here = next(g for g, end in enumerate(self.ends) if end > max(first, self.at))
        if here != self.group:
            self.group, self.at = here, self.ends[here - 1] if here else 0
            self.batches = self.file.iter_batches(10_000, [here], self.columns)
        self.rest = next(self.batches)


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, stop: int):
        self.path, self.first, self.stop = path, first, stop


class RowRangeSource(DataSource):
    """Options: ``path``, a folder of Parquet files that are added in the order of their names and never changed;
    ``max_rows`` of a batch; ``task_rows``, how many of them one task reads; ``checkpoint``, that of the query;
    ``lane`` of how many ``lanes`` the query is.
    """

    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["table"]))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RowRangeReader(dict(self.options), schema)


class RowRangeReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"].rstrip("/"), schema.fieldNames()
        self.max_rows, self.task_rows = int(options["max_rows"]), int(options["task_rows"])
        self.checkpoint = options["checkpoint"].rstrip("/")
        self.lane, self.lanes = int(options.get("lane", 0)), int(options.get("lanes", 1))
        self.place: dict | None = None
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def latestOffset(self) -> dict:
        """The end of the next batch, or where the files end before that."""
        place = self.place or self._logged() or self.initialOffset()
        first, stop = self._batch(place)
        for name, before in self._files_from(place):
            size = self._size(name)
            if before + size > first:
                place = {"file": name, "row": min(stop - before, size)} | self._mark(before)
            if before + size >= stop:
                break
        self.place = place
        return place

    def partitions(self, start: dict, end: dict) -> list[_Rows]:
        self.place = end
        begin, _ = self._batch(start)
        out = []
        for name, before in self._files_from(start):
            if name > end["file"]:
                break
            first, stop = max(begin - before, 0), end["row"] if name == end["file"] else self._size(name)
            out += [_Rows(f"{self.path}/{name}", a, min(a + self.task_rows, stop)) for a in range(first, stop, self.task_rows)]
        return out

    def _batch(self, place: dict) -> tuple[int, int]:
        """The rows of the batch behind a place, numbered as ``_files_from`` counts them.

        Lanes take turns by the number of the row in the whole folder. A batch that the end of the files has cut short is
        filled by its lane when there are more.
        """
        at = place.get("before", 0) + place["row"]
        if place["file"] and place.get("lane") != self._mark(0).get("lane"):
            raise ValueError(f"a checkpoint goes on with the lane, lanes and max_rows it began with: {place.get('lane')}")
        if self.lanes == 1:
            return at, at + self.max_rows
        number = at // self.max_rows
        number += (self.lane - number) % self.lanes
        return max(at, number * self.max_rows), (number + 1) * self.max_rows

    def _mark(self, before: int) -> dict:
        """What the offset of a lane holds besides file and row: the rows of earlier files, and which lane it is."""
        return {"before": before, "lane": [self.lane, self.lanes, self.max_rows]} if self.lanes > 1 else {}

    def _files_from(self, place: dict) -> Iterator[tuple[str, int]]:
        """The file of the place and the later ones, with the number of rows before each."""
        before = place.get("before", 0)
        for name in self._files():
            if name >= place["file"]:
                yield name, before
                before += self._size(name)

    def read(self, partition: _Rows):
        """Only the row groups that hold the range are read, some rows at a time."""
        disk, name = _disk(partition.path)
        info = disk.get_file_info(name)
        places, key = _places(), (partition.path, info.size, info.mtime_ns, tuple(self.columns))
        kept = max((p for p in places if p[0] == key and p[1].at <= partition.first), key=lambda p: p[1].at, default=None)
        if kept:  # lanes read the same file at other places, the nearest one before the range has least to skip
            places.remove(kept)
        place = kept[1] if kept else _Place(partition.path, self.columns)
        yield from place.rows(partition.first, partition.stop)
        places.append((key, place))
        del places[:-KEPT]

    def _files(self) -> list[str]:
        from pyarrow import fs

        disk, root = _disk(self.path)
        found = disk.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")

    def _size(self, name: str) -> int:
        if name not in self.sizes:
            self.sizes[name] = _file(f"{self.path}/{name}").metadata.num_rows
        return self.sizes[name]

    def _logged(self) -> dict | None:
        """Where a query that is started again stands: the last offset in the log of its checkpoint.

        Spark asks for the next offset without saying which was the last one.
        """
        from pyarrow import fs

        disk, root = _disk(f"{self.checkpoint}/offsets")
        batches = [int(f.base_name) for f in disk.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.isdigit()]
        if not batches:
            return None
        with disk.open_input_stream(f"{root}/{max(batches)}") as log:
            return json.loads(log.read().decode().splitlines()[2])


def row_stream(
    spark: SparkSession, path: str, max_rows: int, checkpoint: str, task_rows: int = 100_000, lane: int = 0, lanes: int = 1
) -> DataFrame:
    """The Parquet files of a folder as a stream of batches of ``max_rows`` rows at most.

    ``checkpoint`` is the checkpoint location the query will be started with.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's planning worker gets no shipped packages
    spark.dataSource.register(RowRangeSource)
    table = spark.read.parquet(path).schema.json()
    return spark.readStream.format("row_ranges").options(
        path=path, max_rows=max_rows, checkpoint=checkpoint, task_rows=task_rows, table=table, lane=lane, lanes=lanes).load()


_LOGS = "spark.sql.streaming.checkpointFileManagerClass"


@contextmanager
def _plain_logs(spark: SparkSession, checkpoint: str) -> Iterator[None]:
    """For queries started meanwhile: a checkpoint on a mounted file system is written with a few calls.

    There Spark's own choice starts ten processes (chmod, readlink) for each of a batch's two log entries, this one two. Both
    write a file beside the entry and rename it.
    """
    was = spark.conf.get(_LOGS, None)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    disk = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if was or disk.getUri().getScheme() != "file":
        yield
        return
    spark.conf.set(_LOGS, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    try:
        yield
    finally:
        spark.conf.unset(_LOGS)


def start_lanes(
    spark: SparkSession, path: str, max_rows: int, handle: Callable[[DataFrame, int], None], checkpoint: str, lanes: int
) -> list[StreamingQuery]:
    """Start a query for each lane; ``handle`` gets the batches of all of them, at once and each with a number of its own.

    A folder is gone on with by as many lanes as it was begun with.
    """

    def numbered(lane: int) -> Callable[[DataFrame, int], None]:
        return lambda batch, i: handle(batch, i * lanes + lane)

    queries = []
    try:
        for lane in range(lanes):
            progress = f"{checkpoint}/lane-{lane}"
            stream = row_stream(spark, path, max_rows, progress, lane=lane, lanes=lanes)
            writer = stream.writeStream.foreachBatch(numbered(lane)).option("checkpointLocation", progress)
            with _plain_logs(spark, progress):
                queries.append(writer.trigger(processingTime="0 seconds").start())
    except Exception:
        for query in queries:
            query.stop()
        raise
    return queries
