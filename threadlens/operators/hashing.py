"""Hashed term frequencies: text as a fixed-width content vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexicon_tokens
from .util import as_col


def token_bucket(token: Column | str, dim: int) -> Column:
    """Bucket of a token: leading hexadecimal digits of its md5, modulo ``dim``."""
    return F.conv(F.substring(F.md5(as_col(token)), 1, 4), 16, 10).cast("int") % dim


def hashed_tf(df: DataFrame, id_col: str, text_col: Column | str, dim: int, out: str = "x") -> DataFrame:
    """(id, out array<double>): share of each bucket among a text's tokens; zeros for a text without any.

    Counts per (text, bucket) combine before the shuffle; a text then has at
    most ``dim`` rows to gather.
    """
    tokens = df.select(id_col, F.explode_outer(lexicon_tokens(as_col(text_col))).alias("_t"))
    counts = tokens.groupBy(id_col, token_bucket("_t", dim).alias("_b")).agg(F.count("_t").alias("_n"))
    g = counts.groupBy(id_col).agg(
        F.sum("_n").alias("_all"),
        F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_n")))).alias("_m"))
    share = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(
        F.col("_all") > 0, F.coalesce(F.try_element_at("_m", i), F.lit(0)) / F.col("_all")).otherwise(F.lit(0.0)))
    return g.select(id_col, share.alias(out))


def hashed_array(text_col: Column | str, dim: int) -> Column:
    """``hashed_tf`` of one text, as a projection: buckets as a string of one character a token, counted by removing each."""
    letters = "".join(chr(i + (0x21 if i < 0xd000 else 0x1000)) for i in range(dim))  # no surrogates
    marks = F.array_join(F.transform(lexicon_tokens(as_col(text_col)), lambda t: F.substr(
        F.lit(letters), token_bucket(t, dim) + 1, F.lit(1))), "")

    def shares(own: Column) -> Column:
        n = F.length(own)
        return F.array(*[F.when(n > 0, (F.octet_length(own) - F.octet_length(F.replace(own, F.lit(c), F.lit(""))))
                                / len(c.encode()) / n).otherwise(F.lit(0.0)) for c in letters])

    # one element, so that the marks are a variable and are computed once
    return F.element_at(F.transform(F.array(marks), shares), 1)
