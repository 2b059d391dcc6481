"""Token expressions. All are built-in functions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token rules of the word-count, Hadoop and vector jobs.
WORD_PATTERN = "([a-z0-9']+)"
WHITESPACE_PATTERN = "[ \\t\\n\\r\\f]+"
VECTOR_PATTERN = "(?U)\\w{2,}"
NOT_HYPHEN_WORD = "[^A-Za-z0-9-]"

# The English stop list of the vector jobs, in its own order.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot
could here's how's let's ought that's there's what's when's where's who's why's would
""".split())


def word_tokens(line: Column, min_len: int = 1) -> Column:
    """Lower-cased runs of letters, digits and apostrophes; null gives no tokens."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(line, F.lit(""))), F.lit(WORD_PATTERN), 1)
    if min_len > 1:
        tokens = F.filter(tokens, lambda w: F.length(w) >= min_len)
    return tokens


def whitespace_tokens(line: Column) -> Column:
    """Case-sensitive tokens between spaces, tabs, newlines, returns and form feeds."""
    return F.filter(F.split(line, WHITESPACE_PATTERN), lambda w: w != "")


def vector_tokens(text: Column) -> Column:
    """Lower-cased Unicode words of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(VECTOR_PATTERN), 0)


def hyphen_tokens(text: Column) -> Column:
    """Lower-cased words over letters, digits and hyphens."""
    return F.filter(
        F.split(F.lower(F.regexp_replace(text, NOT_HYPHEN_WORD, " ")), " +"), lambda w: w != ""
    )
