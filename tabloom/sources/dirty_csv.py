"""CSV whose quotes are escaped both ways and whose fields may hold line breaks.

Spark's own multi-line mode reads a file in one task. Here the file is read
line by line, in as many splits as it has. A line break is inside a field when
the number of quotes before it in the file is odd; that number is summed per
split first, so every split can tell for itself where its records begin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.session import staging_path

_BACKSLASH = "\ue000"
_SPLIT = ["_file", "_start"]
# A record that goes on over more splits than this is no record: strings end at 2 GB.
MAX_SPLITS = 64
# Bytes of records that go on in later splits, at most one a split, up to which they are sent to every task.
SMALL_TAILS = 8 << 20


def _once(df: DataFrame, row: Column) -> DataFrame:
    """The fields of a struct as columns. What is done with them later is not worked out of ``row`` again for each use."""
    return df.select(F.inline(F.array(row)))


def _one_escape(text: Column) -> Column:
    r"""``\\`` to a backslash, ``\"`` to ``""`` and any other escaped character to itself."""
    kept = F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH))
    quotes = F.replace(kept, F.lit('\\"'), F.lit('""'))
    plain = F.replace(F.regexp_replace(quotes, r"\\(.)", "$1"), F.lit(_BACKSLASH), F.lit("\\"))
    return F.when(F.contains(text, F.lit("\\")) | F.contains(text, F.lit(_BACKSLASH)), plain).otherwise(text)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _start, _rec, text): whole records, joined over line and split borders."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        _one_escape(F.col("value")).alias("text"),
    )
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))
    lines = lines.withColumn("_odd", (quotes % 2).cast("int"))

    along = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    opened = lines.groupBy(*_SPLIT).agg(F.sum("_odd").alias("_q"))
    opened = opened.select(*_SPLIT, (F.coalesce(F.sum("_q").over(along), F.lit(0)) % 2).alias("_carry"))
    in_split = Window.partitionBy(*_SPLIT).orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_carry") + F.sum("_odd").over(in_split) - F.col("_odd")
    marked = lines.join(opened, _SPLIT).withColumn("_begin", (before % 2 == 0).cast("int"))
    numbered = marked.withColumn("_rec", F.sum("_begin").over(in_split))
    ordered = F.array_sort(F.collect_list(F.struct("_line", "text")))
    pieces = numbered.groupBy(*_SPLIT, "_rec").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")
    )
    # Written once: the pieces are read three times below, always the same.
    staged = staging_path(spark, "csv-pieces")
    pieces.write.parquet(staged)
    pieces = spark.read.parquet(staged)

    # A piece numbered 0 goes on from the last record begun in an earlier split.
    last = pieces.groupBy(*_SPLIT).agg(F.max("_rec").alias("_last"))
    begun = F.when(F.col("_last") > 0, F.struct("_start", "_last"))
    owner = last.select(*_SPLIT, F.last(begun, ignorenulls=True).over(along).alias("_owner"))
    parts = pieces.filter(F.col("_rec") == 0).join(owner, _SPLIT)
    sizes = parts.groupBy("_file", "_owner").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("_bytes"))
    longest, carried = sizes.agg(F.max("_n"), F.sum("_bytes")).first()
    if (longest or 0) > MAX_SPLITS:
        raise ValueError(f"a record runs over {longest} splits: a quote is left open")
    tails = (
        parts
        .groupBy("_file", F.col("_owner._start").alias("_start"), F.col("_owner._last").alias("_rec"))
        .agg(F.array_sort(F.collect_list(F.struct("_start", "text"))).alias("_t"))
        .select("_file", "_start", "_rec", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("_tail"))
    )
    if (carried or 0) <= SMALL_TAILS:
        tails = F.broadcast(tails)
    whole = pieces.filter(F.col("_rec") > 0).join(tails, [*_SPLIT, "_rec"], "left")
    return whole.select(*_SPLIT, "_rec", F.concat_ws("\n", "text", "_tail").alias("text"))


def scan_dirty_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine). All columns are strings; an empty field stays an empty string.

    Missing fields at the end of a short row are null. A row with too many
    fields goes to the quarantine as its text. With ``header`` every file starts
    with one; without it the columns must be named.
    """
    names = list(columns or spark.read.option("header", True).csv(path).columns)
    records = _records(spark, path)
    if header:
        records = records.filter((F.col("_start") != 0) | (F.col("_rec") != 1))
    body = records.filter(F.col("text") != "").select("text")
    bare = F.regexp_replace("text", '"[^"]*"', "")
    body = _once(body, F.struct("text", F.size(F.split(bare, ",")).alias("_fields")))
    schema = ", ".join(f"`{c}` string" for c in names)
    options = {"escape": '"', "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    good = body.filter(F.col("_fields") <= len(names))
    parsed = _once(good, F.struct("_fields", F.from_csv("text", schema, options).alias("r")))
    rows = parsed.select(
        *[
            F.when(F.col("_fields") > i, F.coalesce(F.col("r").getField(c), F.lit(""))).alias(c)
            for i, c in enumerate(names)
        ]
    )
    return rows, body.filter(F.col("_fields") > len(names)).select("text")
