"""DuckDB twins of the column functions, used only to build oracle SQL.

The oracle runs the same fixed patterns on a different regex engine (RE2)
and a different executor, so agreement checks Spark's plan, not the text.
"""

from __future__ import annotations

from ..functions.clean import stages
from ..functions.patterns import (DIGIT, EMOJI, LEXICON_TOKEN, NON_BLANK,
                                  SENTENCE_BREAK, URL_PLACEHOLDER, WORD_TOKEN)


def lit(s: str) -> str:
    """A SQL string literal; control characters go through ``chr``."""
    parts, buf = [], []
    for ch in s:
        if ord(ch) < 32 or 0x7f <= ord(ch) <= 0x9f:
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def clean(expr: str, **switches: bool) -> str:
    out = expr
    for pat, rep in stages(**switches):
        out = f"regexp_replace({out}, {lit(pat)}, {lit(rep.replace('$1', chr(92) + '1'))}, 'g')"
    return out


def _count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({expr}, ''), {lit(pattern)}, 0)) AS BIGINT)"


def sentence_count(expr: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array(coalesce({expr}, ''), "
            f"{lit(SENTENCE_BREAK)}), lambda p: regexp_matches(p, {lit(NON_BLANK)}))) AS BIGINT)")


def word_count(expr: str) -> str:
    return _count(expr, WORD_TOKEN)


def char_count(expr: str) -> str:
    return f"CAST(length(coalesce({expr}, '')) AS BIGINT)"


def url_count(expr: str) -> str:
    return _count(expr, URL_PLACEHOLDER)


def emoji_count(expr: str) -> str:
    return _count(expr, EMOJI)


def digit_count(expr: str) -> str:
    return _count(expr, DIGIT)


def stat_exprs(expr: str) -> list[str]:
    return [sentence_count(expr), word_count(expr), char_count(expr),
            url_count(expr), emoji_count(expr), digit_count(expr)]


def lexicon_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), {lit(LEXICON_TOKEN)}, 0)"
