"""Word counts and bag-of-words tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_tokens(df: DataFrame, tokens: Column, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.explode(tokens).alias("word"))


def word_freq(df: DataFrame, tokens: Column) -> DataFrame:
    """(word, count). Counts are combined before the shuffle, so frequent words are cheap."""
    return explode_tokens(df, tokens).groupBy("word").agg(F.count("*").alias("count"))


def top_words(freq: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent words, ties in word order."""
    return freq.orderBy(F.desc("count"), F.asc("word")).limit(k)


def ordered_words(freq: DataFrame) -> DataFrame:
    return freq.orderBy(F.desc("count"), F.asc("word"))


def word_metrics(df: DataFrame, tokens: Column) -> DataFrame:
    """One row: lines, words, unique_words.

    Both word numbers come from the frequency table, so the text is tokenised
    once; counting the lines reads no text.
    """
    lines = df.agg(F.count("*")).scalar()
    totals = word_freq(df, tokens).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("words"), F.count("*").alias("unique_words")
    )
    return totals.select(lines.alias("lines"), "words", "unique_words")


def words_of_rows(df: DataFrame, tokens: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, word, tf): each word of a row once, with its count in that row.

    A row counts its own words: its tokens are sorted, and a word's count is the distance to the start of the next.
    Nothing is shuffled, and later steps see one row per word instead of one per token.
    """
    ordered = df.select(*keep, F.sort_array(tokens).alias("_s")).where(F.size("_s") > 0)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", F.greatest(i - 1, F.lit(0))))
    )
    marked = ordered.select(*keep, "_s", starts.alias("_i"))
    ends = F.concat(F.slice("_i", F.lit(2), F.size("_i")), F.array(F.size("_s")))
    zipped = F.zip_with("_i", ends, lambda a, b: F.struct(F.get("_s", a).alias("word"), (b - a).cast("bigint").alias("tf")))
    return marked.select(*keep, F.inline(zipped))


def count_vectors(df: DataFrame, doc_col: str, tokens: Column) -> DataFrame:
    """Sparse bag of words: one row (doc, word, tf) for each cell that is not zero. A document is one row."""
    return words_of_rows(df, tokens, [doc_col])


def vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """(word, df, tf): in how many documents and how often each word occurs.

    Each document counts its own words inside its row, so the text is read and split once.
    """
    return words_of_rows(df, tokens).groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def drop_stop_words(df: DataFrame, words: Sequence[str], column: str = "word") -> DataFrame:
    """Rows whose word is not in the list. The list is a plan-time constant."""
    return df.filter(~F.col(column).isin(list(words)))
