"""Per-text statistics and tokenisation, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (DIGIT_SPARK, EMOJI_SPARK, LEXICON_TOKEN_SPARK, NA_WORDS, NON_BLANK,
                       SENTENCE_BREAK_SPARK, WORD_TOKEN_SPARK)

URL = "[URL]"

# Order of the statistics vector (kept as the reference orders it).
STAT_NAMES = ("n_sentences", "n_words", "n_chars", "n_urls", "n_emoji", "n_digits")


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_empty(text: Column | str) -> Column:
    """Null text -> empty string (applied, unlike the reference's dropped fill)."""
    return F.coalesce(_as_col(text), F.lit(""))


def nan_string(text: Column | str) -> Column:
    """Compatibility cast: null becomes the string ``'nan'``."""
    return F.coalesce(_as_col(text).cast("string"), F.lit("nan"))


def is_empty(text: Column | str) -> Column:
    """Null or zero-length text."""
    t = _as_col(text)
    return t.isNull() | (F.length(t) == 0)


def na_to_null(text: Column | str, na_words=NA_WORDS) -> Column:
    """Missing-value words of a CSV field become null."""
    t = _as_col(text)
    return F.when(t.isin(*na_words), F.lit(None).cast("string")).otherwise(t)


def sentence_count(text: Column | str) -> Column:
    """Sentences: pieces between terminal punctuation followed by space."""
    pieces = F.split(fill_empty(text), SENTENCE_BREAK_SPARK, -1)
    return F.size(F.filter(pieces, lambda p: p.rlike(NON_BLANK))).cast("long")


def word_tokens(text: Column | str) -> Column:
    """Word tokens incl. single punctuation marks; hyphen/apostrophe joins."""
    return F.regexp_extract_all(fill_empty(text), F.lit(WORD_TOKEN_SPARK), 0)


def word_count(text: Column | str) -> Column:
    """Number of word tokens, counted without materialising them."""
    return F.regexp_count(fill_empty(text), F.lit(WORD_TOKEN_SPARK)).cast("long")


def char_count(text: Column | str) -> Column:
    """Code points, as Python's ``len``."""
    return F.length(fill_empty(text)).cast("long")


def url_count(text: Column | str) -> Column:
    """Non-overlapping ``[URL]`` placeholders (made by the cleaner)."""
    t = fill_empty(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(URL), F.lit("")))) / len(URL)).cast("long")


def emoji_count(text: Column | str) -> Column:
    """Emoji, with flags, keycaps and joined sequences counted once."""
    t = fill_empty(text)
    plain = F.octet_length(t) == F.length(t)  # every emoji has a character beyond ASCII
    return F.when(plain, F.lit(0)).otherwise(F.regexp_count(t, F.lit(EMOJI_SPARK))).cast("long")


def digit_count(text: Column | str) -> Column:
    """Characters Python's ``str.isdigit`` accepts."""
    return F.regexp_count(fill_empty(text), F.lit(DIGIT_SPARK)).cast("long")


def stat_columns(text: Column | str) -> list[Column]:
    """The six statistics as named long columns, in vector order."""
    t = _as_col(text)
    exprs = (sentence_count(t), word_count(t), char_count(t), url_count(t),
             emoji_count(t), digit_count(t))
    return [e.alias(n) for e, n in zip(exprs, STAT_NAMES)]


def stat_vector(text: Column | str) -> Column:
    """The six statistics as ``array<double>`` in fixed order."""
    t = _as_col(text)
    return F.array(*[e.cast("double") for e in (
        sentence_count(t), word_count(t), char_count(t), url_count(t),
        emoji_count(t), digit_count(t))])


def lexicon_tokens(text: Column | str) -> Column:
    """Unicode word runs of the lower-cased text (lexicon tokenizer)."""
    return F.regexp_extract_all(F.lower(fill_empty(text)), F.lit(LEXICON_TOKEN_SPARK), 0)
