"""Folds, row keys and staged tables shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabloom.session import staging_path


def fold(doc_id: str | Column) -> Column:
    """``crc32(doc_id as text) mod 3``; a missing id falls into fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 3, F.lit(0))


def held_out(doc_id: str | Column) -> Column:
    """True for the rows no model may learn from."""
    return fold(doc_id) == 1


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's content; rows with the same content share it and get the same result."""
    return F.xxhash64(*[F.col(c) for c in cols])


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again.

    Jobs that use it later start from the files, so a lost executor costs no more than the lost tasks.
    """
    spark: SparkSession = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, keep: Sequence[str], text: str, fields: str, work: Callable[[list], Sequence],
              rows: int = 0) -> DataFrame:
    """``keep`` columns as they are, and the columns ``fields`` that ``work`` makes of a list of texts.

    ``work`` gets the texts of a batch (of ``rows`` at most, if given) and returns one list or array per field. The kept
    columns stay in Arrow, so whole numbers beside nulls keep all their digits.
    """
    source = df.select(*keep, F.col(text).alias("__text"))
    made = T.StructType.fromDDL(fields)
    schema = T.StructType(source.schema.fields[:-1] + made.fields)
    kinds = [to_arrow_type(f.dataType) for f in made.fields]
    names = schema.fieldNames()

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, rows or whole.num_rows):
                batch = whole.slice(a, rows or whole.num_rows)
                new = work(batch.column(batch.num_columns - 1).to_pylist())
                new = [pa.array(values, kind) for values, kind in zip(new, kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)

    return source.mapInArrow(run, schema)


def file_system(path: str):
    """The Arrow file system of a path or address, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
