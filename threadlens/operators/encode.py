"""Text -> token ids against a corpus vocabulary; truncation, padding, masks.

Vocabulary: every token of the corpus by falling count (ties: token order), ids
after the four special ids; optionally only the ``size`` most frequent. Numbers
are distributed positions and the vocabulary is a table like any other: nothing
of it passes the driver. Encoding cuts a text's tokens at the limit, explodes
them with their positions (each text's group is at most ``max_len`` ids), joins
the vocabulary and regroups by text. The ``HEAD`` most frequent tokens, which are
most of all occurrences, are joined by broadcast, so that no occurrence of a stop
word is shuffled by its token; only the others meet the rest of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import WORD_TOKEN_SPARK
from ..functions.text import fill_empty
from ..session import materialize
from .ordered import positions
from .util import as_col, broadcast_if_bounded

# Special token ids.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
N_SPECIAL = 4

#: Tokens whose ids are broadcast: those of the first ids, so at most so many rows.
HEAD = 4096


def encoder_tokens(text: Column | str) -> Column:
    """Lower-cased words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(fill_empty(as_col(text))), F.lit(WORD_TOKEN_SPARK), 0)


def vocabulary(df: DataFrame, text: Column | str, size: int | None = None) -> DataFrame:
    """(token, id, n) of all tokens, or of the ``size`` most frequent; map-side partial counts."""
    counts = df.select(F.explode(encoder_tokens(text)).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    if size is not None:
        counts = counts.orderBy(F.col("n").desc(), F.col("token").asc()).limit(size)
    ranked = positions(counts.withColumn("_less", -F.col("n")), [], ["_less", "token"], out="_pos")
    return ranked.select("token", (F.col("_pos") + N_SPECIAL - 1).cast("int").alias("id"), "n")


def fit_vocabulary(df: DataFrame, text: Column | str, size: int | None = None) -> DataFrame:
    """Compute the vocabulary once, for plans that encode several times."""
    return materialize(vocabulary(df, text, size))


def save_vocabulary(vocab: DataFrame, path: str) -> str:
    vocab.write.mode("overwrite").parquet(path)
    return path


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("token", "id", "n")


def encode(df: DataFrame, keys: list[str], text: Column | str, vocab: DataFrame,
           max_len: int = 512, carry: tuple[str, ...] = (), head: int = HEAD) -> DataFrame:
    """(keys..., carry..., input_ids array<int>, n_tokens): CLS ids SEP, with
    at most ``max_len`` ids in all; ``n_tokens`` counts the whole text."""
    toks = df.select(*keys, *carry, encoder_tokens(text).alias("_t"))
    ex = toks.select(*keys, *carry, F.size("_t").cast("long").alias("n_tokens"),
                     F.posexplode_outer(F.slice("_t", 1, max_len - 2)).alias("pos", "token"))
    ids = vocab.select("token", F.col("id").alias("_tid"))
    frequent = F.col("_tid") < N_SPECIAL + head
    near = ex.join(broadcast_if_bounded(ids.filter(frequent), head), "token", "left")
    known = F.col("_tid").isNotNull() | F.col("pos").isNull()
    # always by shuffle: were both parts still dealt by text, their union would count on equal numbers of partitions
    rest = near.filter(~known).drop("_tid").join(ids.filter(~frequent).hint("merge"), "token", "left")
    j = near.filter(known).unionByName(rest)
    # position and id in one number, which sorts and travels lighter than a struct of both
    item = F.when(F.col("pos").isNotNull(),
                  F.shiftleft(F.col("pos").cast("long"), 32) + F.coalesce(F.col("_tid"), F.lit(UNK)))
    g = j.groupBy(*keys, *carry, "n_tokens").agg(F.sort_array(F.collect_list(item)).alias("_p"))
    ids = F.concat(F.array(F.lit(CLS)), F.transform("_p", lambda p: p.bitwiseAND(F.lit(0xffffffff)).cast("int")), F.array(F.lit(SEP)))
    return g.select(*keys, *carry, ids.alias("input_ids"), "n_tokens")


def pad(encoded: DataFrame, by: list[str], max_groups: int, ids: str = "input_ids") -> DataFrame:
    """Pad to the longest sequence of each group (e.g. split) and add the mask.

    The per-group maxima form a table with one row per group, at most
    ``max_groups`` (the caller's domain, e.g. three splits); it is
    broadcast back. A shuffle join on a key with so few values would put
    all rows into a handful of tasks. The sequences are read twice, for their
    lengths and for themselves, so they are computed once before.
    """
    encoded = materialize(encoded)
    longest = encoded.groupBy(*by).agg(F.max(F.size(ids)).alias("_max"))
    j = encoded.join(broadcast_if_bounded(longest, max_groups), by)
    n = F.size(ids)
    fill = F.col("_max") - n
    return j.withColumns({
        ids: F.concat(F.col(ids), F.array_repeat(F.lit(PAD), fill)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)),
    }).drop("_max")
