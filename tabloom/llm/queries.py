"""The registered queries of this package and, where SQL can say the same, their check SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    ann, decontaminate, html_text, langid, licenses, line_dedup, mixing, near_dup, periodic, quality, ranked, token_files,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_language_id")
def op1_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op8_quality")
def op8_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, _table(spark, sf_dir, "labels")).drop("text")


@_query("op5_near_dup")
def op5_near_dup(spark, sf_dir):
    return near_dup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op7_decontaminate")
def op7_decontaminate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, _table(spark, sf_dir, "benchmark"))


@_query("op9_mix")
def op9_mix(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query("op10_line_dedup", line_dedup.ORACLE)
def op10_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.strip(docs).drop("source")


@_query("op3_neighbours")
def op3_neighbours(spark, sf_dir):
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query("op4_licenses")
def op4_licenses(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query("op6_html_text")
def op6_html_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query("op11_ranked_search", ranked.ORACLE)
def op11_ranked_search(spark, sf_dir):
    return ranked.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op12_token_ids")
def op12_token_ids(spark, sf_dir):
    return token_files.read(token_files.write(_table(spark, sf_dir, "documents")))


def _planted(doc_id, words):
    """The contract's periodic texts: every tenth document, by the crc32 of its id, repeats from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    a = h // 10 % len(words)
    p = 1 + (len(words) - a) // (3 + h // 10 % 8)
    turn = words[a:a + p]
    return words[:a] + (turn * ((len(words) - a) // p + 1))[:len(words) - a]


@_query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    found = periodic.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), alter=_planted)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start, r.period)))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    found = found.withColumn("best", longest).select("*", (-F.col("best.less")).alias("length"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length",
        F.col("best.period").alias("period"), F.expr("1000 * length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
