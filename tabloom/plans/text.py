"""Word-count and bag-of-words queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import text as ft
from tabloom.operators import text as ot
from tabloom.plans.registry import query, table

_WORDS = "SELECT unnest(regexp_extract_all(lower(text), '([a-z0-9'']+)', 1)) AS word FROM documents"
_FREQ = f'SELECT word, count(*) AS "count" FROM ({_WORDS}) GROUP BY word'
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in ft.STOP_WORDS)
_VEC = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]{2,}')) AS word FROM documents"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")


@query("line_count", """
    SELECT sum(len(string_split(text, chr(10)))) :: BIGINT AS lines FROM documents
""")
def line_count(spark, sf_dir):
    lines = _docs(spark, sf_dir).select(F.size(F.split("text", "\n")).alias("n"))
    return lines.agg(F.sum("n").alias("lines"))


@query("token_count", f"SELECT count(*) AS words FROM ({_WORDS})")
def token_count(spark, sf_dir):
    return _docs(spark, sf_dir).agg(
        F.sum(F.size(ft.word_tokens(F.col("text")))).alias("words")
    )


@query("distinct_count", f"SELECT count(DISTINCT word) AS unique_words FROM ({_WORDS})")
def distinct_count(spark, sf_dir):
    words = ot.explode_tokens(_docs(spark, sf_dir), ft.word_tokens(F.col("text")))
    return words.agg(F.count_distinct("word").alias("unique_words"))


@query("distinct_words", f"SELECT DISTINCT word FROM ({_WORDS})")
def distinct_words(spark, sf_dir):
    return ot.explode_tokens(_docs(spark, sf_dir), ft.word_tokens(F.col("text"))).distinct()


@query("word_freq", _FREQ)
def word_freq(spark, sf_dir):
    return ot.word_freq(_docs(spark, sf_dir), ft.word_tokens(F.col("text")))


@query("word_freq_topk", f'{_FREQ} ORDER BY "count" DESC, word LIMIT 5')
def word_freq_topk(spark, sf_dir):
    return ot.top_words(word_freq(spark, sf_dir), 5)


@query("sort_full", _FREQ)
def sort_full(spark, sf_dir):
    return ot.ordered_words(word_freq(spark, sf_dir))


@query("word_freq_ws", """
    SELECT word, count(*) AS "count" FROM (
      SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word
""")
def word_freq_ws(spark, sf_dir):
    return ot.word_freq(_docs(spark, sf_dir), ft.whitespace_tokens(F.col("text")))


@query("min_token_len", f"""
    SELECT word, count(*) AS "count" FROM ({_WORDS}) WHERE length(word) >= 4 GROUP BY word
""")
def min_token_len(spark, sf_dir):
    return ot.word_freq(_docs(spark, sf_dir), ft.word_tokens(F.col("text"), min_len=4))


@query("word_metrics", f"""
    SELECT (SELECT count(*) FROM documents) AS lines, count(*) AS words,
           count(DISTINCT word) AS unique_words
    FROM ({_WORDS})
""")
def word_metrics(spark, sf_dir):
    return ot.word_metrics(_docs(spark, sf_dir), ft.word_tokens(F.col("text")))


@query("word_freq_by_role", """
    SELECT role, word, count(*) AS "count" FROM (
      SELECT role, unnest(regexp_extract_all(lower(text), '([a-z0-9'']+)', 1)) AS word
      FROM conversations) GROUP BY role, word
""")
def word_freq_by_role(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", heavy=True)
    words = ot.explode_tokens(turns, ft.word_tokens(F.col("text")), ["role"])
    return words.groupBy("role", "word").agg(F.count("*").alias("count"))


@query("count_vectors", f"SELECT doc_id, word, count(*) AS tf FROM ({_VEC}) GROUP BY doc_id, word")
def count_vectors(spark, sf_dir):
    return ot.count_vectors(_docs(spark, sf_dir), "doc_id", ft.vector_tokens(F.col("text")))


@query("vocab_df", f"""
    SELECT word, count(DISTINCT doc_id) AS df, count(*) AS tf FROM ({_VEC}) GROUP BY word
""")
def vocab_df(spark, sf_dir):
    return ot.vocabulary(_docs(spark, sf_dir), ft.vector_tokens(F.col("text")))


@query("stopword_filter", f"""
    SELECT word, count(*) AS "count" FROM ({_VEC}) WHERE word NOT IN ({_STOP_SQL}) GROUP BY word
""")
def stopword_filter(spark, sf_dir):
    words = ot.explode_tokens(_docs(spark, sf_dir), ft.vector_tokens(F.col("text")))
    kept = ot.drop_stop_words(words, ft.STOP_WORDS)
    return kept.groupBy("word").agg(F.count("*").alias("count"))


@query("tokenize_keep_hyphen", """
    SELECT word, count(*) AS "count" FROM (
      SELECT unnest(string_split_regex(lower(regexp_replace(text, '[^A-Za-z0-9-]', ' ', 'g')), ' +'))
        AS word FROM documents)
    WHERE word <> '' GROUP BY word
""")
def tokenize_keep_hyphen(spark, sf_dir):
    return ot.word_freq(_docs(spark, sf_dir), ft.hyphen_tokens(F.col("text")))
