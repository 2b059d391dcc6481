"""Cross-site boilerplate removal: lines that stand on many different sites.

Spread is the number of distinct sites of a line, gathered as one HyperLogLog sketch per line hash; sketches merge in
the aggregation, so a line that a third of all documents have is no larger than any other. Lines whose estimate is
near the threshold are counted exactly. Everything is DataFrame operations.

The lines found are few as a rule. Up to ``LISTED`` of them go to the tasks as a list of hashes, and no text is moved. More
are joined to the lines of the documents, and the texts meet their hits in a shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import common

MIN_SITES = 10
NEAR = 0.2
LG_K = 10
LISTED = 4_000


def line_hash(line: Column) -> Column:
    """Null for a blank line; letter case and outer blanks do not matter."""
    bare = F.lower(F.trim(F.replace(line, F.lit("\r"), F.lit(""))))
    return F.when(bare != "", F.xxhash64(bare))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, lg_k: int = LG_K) -> DataFrame:
    """``line``: the hashes of all lines of ``docs`` (text, source) that stand on ``min_sites`` sites or more.

    A null source is a site of its own. Estimates within ``near`` of the threshold, at least one site to either side,
    are replaced by exact counts. The error of a sketch of 2 ** ``lg_k`` cells is about 3 % at 10 cells, and
    few-site sketches are exact, so the result is that of exact counting.
    """
    site = F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    lines = docs.select(site.alias("site"), F.explode(F.transform(F.split("text", "\n"), line_hash)).alias("line"))
    lines = lines.where("line is not null")
    sketch = lines.groupBy("line").agg(F.hll_sketch_agg("site", lg_k).alias("s"))
    guess = sketch.select("line", F.hll_sketch_estimate("s").alias("sites"))
    band = max(1.0, near * min_sites)
    guess = common.staged(guess.where(F.col("sites") >= min_sites - band), "spread")
    close = guess.where(F.col("sites") <= min_sites + band).select("line")
    exact = lines.distinct().join(close, "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites"))
    return guess.where(F.col("sites") > min_sites + band).select("line").unionByName(
        exact.where(F.col("sites") >= min_sites).select("line"))


def _listed(few: list[int], line: Column) -> Column:
    return line.isin(few)


def _joined(line: Column) -> Column:
    return F.array_contains("__bad", line)


def strip(docs: DataFrame, min_sites: int = MIN_SITES, counters: bool = True, listed: int = LISTED) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and with ``counters`` ``n_lines`` and ``n_removed``.

    A document that would lose all its lines but blank ones is left whole: of a text that stands on ``min_sites`` sites
    every line does, so its copies are among these, and near-duplicate removal decides on them. Null text stays null
    with no lines, and blank lines stay. Rows that repeat are treated alike. ``n_chars``, if there is one, follows the
    text. The counters take the place of columns of their names. More than ``listed`` boilerplate lines are joined.
    """
    bad = common.staged(spread_lines(docs.select("text", "source"), min_sites), "boilerplate")
    few = [r.line for r in bad.limit(listed + 1).collect()]
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # the text moves but once
    both = docs.select(F.xxhash64("doc_id", "source", "text").alias("__key"), rest.alias("__row"),
                       F.col("text").alias("__text"))
    if len(few) <= listed:
        is_bad = functools.partial(_listed, few)
    else:
        own = docs.select(F.xxhash64("doc_id", "source", "text").alias("__key"),  # before the lines part: once a text
                          F.array_distinct(F.transform(F.split("text", "\n"), line_hash)).alias("lines"))
        hits = own.select("__key", F.explode("lines").alias("line")).join(bad, "line")
        both = both.join(hits.groupBy("__key").agg(F.collect_set("line").alias("__bad")), "__key", "left")
        is_bad = _joined
    both = both.withColumn("__lines", F.split("__text", "\n"))
    both = both.withColumn("__kept", F.filter("__lines", lambda x: ~F.coalesce(is_bad(line_hash(x)), F.lit(False))))
    both = both.select("__row", "__text", "__kept", F.size("__lines").alias("__all"))
    cut = (F.size("__kept") < F.col("__all")) & F.exists("__kept", lambda x: line_hash(x).isNotNull())
    both = both.withColumn("__cut", cut).withColumn(
        "__new", F.when(F.col("__cut"), F.array_join("__kept", "\n")).otherwise(F.col("__text")))
    changed = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__cut"), F.length("__new")).otherwise(F.col("__row.n_chars")).cast(
            docs.schema["n_chars"].dataType)
    counted = {}
    if counters:
        counted["n_lines"] = F.when(F.col("__text").isNull(), 0).otherwise(F.col("__all")).cast("long")
        counted["n_removed"] = F.when(F.col("__cut"), F.col("__all") - F.size("__kept")).otherwise(0).cast("long")
    columns = [(changed[c] if c in changed else F.col("__row").getField(c)).alias(c) for c in docs.columns
               if c not in counted]
    return both.select(*columns, *[c.alias(name) for name, c in counted.items()])


ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rn, doc_id, text, coalesce('s' || source, '') AS site,
         CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS parts
  FROM documents),
lines AS (
  SELECT rn, site, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i FROM docs),
bare AS (
  SELECT *, nullif(trim(lower(trim(replace(raw, chr(13), ''), ' ')), ' '), '') AS line FROM lines),
bad AS (SELECT line FROM bare WHERE line IS NOT NULL GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
cut AS (
  SELECT rn, count(*) AS kept, string_agg(raw, chr(10) ORDER BY i) AS new
  FROM bare WHERE line IS NULL OR line NOT IN (SELECT line FROM bad) GROUP BY rn HAVING count(line) > 0)
SELECT doc_id, len(parts) :: BIGINT AS n_lines, len(parts) - coalesce(kept, len(parts)) :: BIGINT AS n_removed,
       coalesce(new, text) AS text
FROM docs LEFT JOIN cut USING (rn)
"""
