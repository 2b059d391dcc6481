"""One ordered file written by many tasks.

Rows are range-sorted, each line's place in the file follows from the running sum of the lines' lengths, and every task
writes its lines at their places. A task that runs again writes the same bytes to the same places, so nothing has to
be put together afterwards and no task or driver sees the whole. The path must be on a file system that is
mounted where tasks run and lets them write at a place (POSIX); object stores and HDFS do not.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import BLOCK_ROWS, running_sums, split_long
from tabloom.session import staging_path


def _local(path: str) -> str:
    path = re.sub(r"^file:/+", "/", path)
    if not path.startswith("/"):
        raise ValueError("one file needs a path on a mounted file system")
    return path


def sink_csv_file(df: DataFrame, path: str, order: Sequence[Column], block_rows: int = BLOCK_ROWS) -> int:
    """Write ``df`` in the given order as one CSV file with a header; returns its size in bytes.

    Rows that tie in ``order`` keep one order from then on. A file that is there is replaced.
    """
    target = _local(path)
    spark = df.sparkSession
    staged = staging_path(spark, "lines")
    line = F.to_csv(F.struct(*df.columns), {"escape": '"'})
    ordered = df.orderBy(*order).select(line.alias("line"), F.monotonically_increasing_id().alias("_at"))
    ordered.write.parquet(staged)
    lines = spark.read.parquet(staged)
    header = (",".join(df.columns) + "\n").encode()
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "wb") as out:
        out.write(header)
    ends = running_sums(split_long(lines, [], "_at", block_rows), {"_end": F.octet_length("line") + 1})

    def write(batches):
        size = 0
        with open(target, "r+b") as out:
            for batch in batches:
                at = None
                for text, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = text.encode() + b"\n"
                    if at != end - len(data):
                        out.seek(len(header) + end - len(data))
                    out.write(data)
                    at = end
                    size += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([size])], ["size"])

    written = ends.select("line", "_end").mapInArrow(write, "size bigint")
    return len(header) + (written.agg(F.sum("size")).first()[0] or 0)
