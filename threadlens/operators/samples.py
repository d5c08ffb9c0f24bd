"""Sample assembly: token ids + statistics + lexicon counts (+ label).

One record per text, joined on the text id (never by position):
``content`` = struct(input_ids, attention_mask), ``stat_vec`` and
``lex_vec`` as ``array<double>`` (standardised when scalers are given).
The statistics ride through the lexicon aggregate, and the ids come from a
second aggregate on the same key, so the two sides are co-partitioned and
their join adds no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STAT_NAMES, stat_columns
from .encode import encode, pad
from .lexicon import Lexicon, lexicon_vector
from .scaling import ScalerModel


def text_features(texts: DataFrame, id_col: str, text_col: str, lex: Lexicon, split_col: str = "split") -> DataFrame:
    """(id, split, statistics..., lex_vec) of cleaned texts, unscaled."""
    d = texts.select(id_col, split_col, text_col, *stat_columns(text_col))
    return lexicon_vector(d, id_col, text_col, lex, carry=(split_col, *STAT_NAMES))


def assemble_samples(texts: DataFrame, id_col: str, text_col: str, lex: Lexicon,
                     vocab: DataFrame, max_len: int = 512,
                     split_col: str = "split", labels: DataFrame | None = None,
                     label_col: str = "label", labelled: bool = True,
                     stat_scaler: ScalerModel | None = None,
                     lex_scaler: ScalerModel | None = None,
                     pad_groups: int | None = None,
                     features: DataFrame | None = None) -> DataFrame:
    """Build samples from cleaned texts ``(id, split, text)``.

    ``labels`` (id, label): with ``labelled`` the samples of labelled texts
    carry their label; otherwise the samples of texts without a label are
    returned (no label column). ``pad_groups`` pads ids within each split
    (at most that many splits) and adds the attention mask; without it the
    mask is all ones. ``features`` are the ``text_features`` of the texts, or
    of more texts, where the caller has them (it fits scalers on them).
    """
    lab = None
    if labels is not None:  # first: no work for texts that the result leaves out
        lab = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
        chosen = "left_semi" if labelled else "left_anti"
        texts = texts.join(lab.select(id_col), id_col, chosen)
        if features is not None:
            features = features.join(lab.select(id_col), id_col, chosen)
    v = text_features(texts, id_col, text_col, lex, split_col) if features is None else features
    stats = F.array(*[F.col(n).cast("double") for n in STAT_NAMES])
    if stat_scaler is not None:
        stats = stat_scaler.array(stats)
    lexv = F.transform("lex_vec", lambda x: x.cast("double"))
    if lex_scaler is not None:
        lexv = lex_scaler.array(lexv)
    v = v.select(id_col, split_col, stats.alias("stat_vec"), lexv.alias("lex_vec"))
    e = encode(texts, [id_col], text_col, vocab, max_len, carry=(split_col,))
    if pad_groups is not None:
        e = pad(e, [split_col], pad_groups)
    else:
        e = e.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    e = e.select(id_col, F.struct("input_ids", "attention_mask").alias("content"))
    s = v.join(e, id_col)
    return s.join(lab, id_col) if labels is not None and labelled else s
