"""Comment-markup cleaner as one chain of built-in string expressions.

Catalyst collapses the chain into a single Project and no Python runs per
row. Literal stages are plain replacements and the trim is ``btrim``, which is
linear in the text whatever it holds; the other stages are ``regexp_replace``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import CLEAN_LITERALS, CLEAN_SPARK, CLEAN_STAGES, CLEAN_SWITCHES, CLEAN_TRIM, WS_CHARS


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stages(**switches: bool) -> list[tuple[str, str]]:
    """The (pattern, replacement) stages enabled by the switches, in order."""
    unknown = set(switches) - set(CLEAN_SWITCHES)
    if unknown:
        raise ValueError(f"unknown cleaner switches: {sorted(unknown)}")
    on = {s: switches.get(s, True) for s in CLEAN_SWITCHES}
    return [(pat, rep) for sw, pat, rep in CLEAN_STAGES if on[sw]]


def _stage(text: Column, pattern: str, replacement: str) -> Column:
    if pattern == CLEAN_TRIM:
        return F.btrim(text, F.lit(WS_CHARS))
    if pattern in CLEAN_LITERALS:
        return F.replace(text, F.lit(CLEAN_LITERALS[pattern]), F.lit(replacement))
    return F.regexp_replace(text, F.lit(CLEAN_SPARK.get(pattern, pattern)), F.lit(replacement))


def clean(text: Column | str, *, newline: bool = True, quote: bool = True,
          bullet_point: bool = True, link: bool = True, strikethrough: bool = True,
          spoiler: bool = True, code: bool = True, superscript: bool = True,
          table: bool = True, heading: bool = True) -> Column:
    """Clean community-markup text; every stage can be switched off.

    Order matters and the result is not idempotent: a second pass can change
    the text again (``g*t`` -> ``gt`` -> ``''``).
    """
    out = _as_col(text)
    for pat, rep in stages(newline=newline, quote=quote, bullet_point=bullet_point,
                           link=link, strikethrough=strikethrough, spoiler=spoiler,
                           code=code, superscript=superscript, table=table,
                           heading=heading):
        out = _stage(out, pat, rep)
    return out


def post_text(title: Column | str, body: Column | str, **switches: bool) -> Column:
    """A post is its title and body joined by one space, then cleaned."""
    return clean(F.concat_ws(" ", _as_col(title), _as_col(body)), **switches)
