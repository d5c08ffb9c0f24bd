"""Registered queries: vocabulary, id encoding, padding/masks, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..functions.patterns import LEXICON_TOKEN, WORD_TOKEN
from ..functions.text import STAT_NAMES
from ..operators import encode as EN
from ..operators import lexicon as LX
from ..operators.samples import assemble_samples, text_features
from ..session import materialize, scratch_path, store
from ..sources.tables import read_table
from . import inputs as I
from . import sqltext as S
from .q_features import _LEX_WIDE_SQL, _STATS_SQL, FIT_SPLITS, LEX_COLS, _apply_sql, _lexicon, fit_both
from .registry import register

MAX_LEN = 512


def _ids_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def _vocab(spark, sf):
    return EN.fit_vocabulary(I.spread_docs(spark, sf), "c")


_TOKS = f"regexp_extract_all(lower(coalesce(c, '')), {S.lit(WORD_TOKEN)}, 0)"
VOCAB_SQL = (f"(SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id, n FROM "
             f"(SELECT token, count(*) AS n FROM (SELECT unnest({_TOKS}) AS token FROM {I.CLEANED_DOCS_SQL}) "
             f"GROUP BY token))")


@register("vocabulary", f"SELECT token, id, n FROM {VOCAB_SQL}")
def vocabulary(spark, sf):
    """All tokens of the cleaned documents by count, ids after the special ids."""
    return EN.vocabulary(I.spread_docs(spark, sf), "c")


def _encode_sql(src, keys):
    k = ", ".join(keys)
    return (f"(WITH voc AS {VOCAB_SQL}, "
            f"base AS (SELECT {k}, {_TOKS} AS toks FROM {src}), "
            f"ex AS (SELECT {k}, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM base), "
            f"enc AS (SELECT {k}, string_agg(CAST(coalesce(voc.id, 1) AS VARCHAR), ' ' ORDER BY pos) AS s, "
            f"count(*) AS m FROM ex LEFT JOIN voc ON voc.token = ex.token WHERE pos <= {MAX_LEN - 2} GROUP BY {k}) "
            f"SELECT {', '.join('base.' + x for x in keys)}, CAST(len(base.toks) AS BIGINT) AS n_tokens, "
            "CASE WHEN enc.s IS NULL THEN '2 3' ELSE '2 ' || enc.s || ' 3' END AS input_ids, "
            "CAST(coalesce(enc.m, 0) + 2 AS INTEGER) AS n_ids "
            f"FROM base LEFT JOIN enc ON {' AND '.join(f'base.{x} = enc.{x}' for x in keys)})")


_CONV_SQL = f"(SELECT conv_id, turn, {S.clean('text')} AS c FROM conversations)"


@register("encode_ids", f"SELECT conv_id, turn, n_tokens, input_ids FROM {_encode_sql(_CONV_SQL, ['conv_id', 'turn'])}")
def encode_ids(spark, sf):
    """Replies encoded with the document vocabulary: CLS ids SEP, 512 max."""
    c = read_table(spark, sf, "conversations").select(
        "conv_id", "turn", tf.clean("text").alias("c"))
    e = EN.encode(c, ["conv_id", "turn"], "c", _vocab(spark, sf), MAX_LEN)
    return e.select("conv_id", "turn", "n_tokens", _ids_str("input_ids").alias("input_ids"))


_DOC_KEYS_SQL = f"(SELECT id AS doc_id, split, c FROM {I.CLEANED_DOCS_SQL})"


@register("encode_padded_mask",
          f"WITH e AS (SELECT d.split, x.* FROM {_encode_sql(_DOC_KEYS_SQL, ['doc_id'])} x "
          f"JOIN {_DOC_KEYS_SQL} d ON d.doc_id = x.doc_id), mx AS (SELECT split, max(n_ids) AS m FROM e GROUP BY split) "
          "SELECT e.doc_id, e.split, mx.m AS padded_len, e.n_ids AS mask_sum, "
          "e.input_ids || repeat(' 0', mx.m - e.n_ids) AS input_ids, "
          "trim(repeat('1 ', e.n_ids) || repeat('0 ', mx.m - e.n_ids)) AS attention_mask "
          "FROM e JOIN mx ON e.split = mx.split")
def encode_padded_mask(spark, sf):
    """Documents encoded, padded to the longest of their split, with masks."""
    d = store(I.spread_docs(spark, sf), "cleaned")
    e = EN.encode(d, ["doc_id"], "c", EN.fit_vocabulary(d, "c"), MAX_LEN, carry=("split",))
    p = EN.pad(e, ["split"], max_groups=len(I.SPLITS))
    return p.select("doc_id", "split", F.size("input_ids").alias("padded_len"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                    _ids_str("input_ids").alias("input_ids"),
                    _ids_str("attention_mask").alias("attention_mask"))


def _samples(spark, sf, labelled):
    """Sample records: ids padded within their split, mask, scaled vectors; as strings for the oracle.

    Scalers (train and validate), vocabulary and samples read texts that are cleaned once, and
    the scalers and samples the same statistics and lexicon counts.
    """
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    lex = _lexicon(spark)
    docs = store(I.spread_docs(spark, sf), "cleaned")
    v = materialize(text_features(docs, "doc_id", "c", lex))
    stats, lexicon = fit_both(v.filter(F.col("split").isin(*FIT_SPLITS)))
    s = assemble_samples(docs, "doc_id", "c", lex, EN.fit_vocabulary(docs, "c"), MAX_LEN, labels=lab, labelled=labelled,
                         stat_scaler=stats, lex_scaler=lexicon, pad_groups=len(I.SPLITS), features=v)
    z = [F.round(F.element_at("stat_vec", i + 1), 6).alias(f"z_{n}") for i, n in enumerate(STAT_NAMES)]
    z += [F.round(F.element_at("lex_vec", i + 1), 6).alias(f"z_{c}") for i, c in enumerate(LEX_COLS)]
    cols = ["doc_id", "split", _ids_str("content.input_ids").alias("input_ids"),
            _ids_str("content.attention_mask").alias("attention_mask"), *z]
    return s.select(*cols, "label") if labelled else s.select(*cols)


def _samples_sql(chosen):
    """Samples of the documents in ``chosen``; ids are padded to the longest of these in their split."""
    zs = ", ".join(f"zs.z_{n}" for n in STAT_NAMES)
    zl = ", ".join(f"zl.z_{c}" for c in LEX_COLS)
    return (
        f"(WITH zs AS ({_apply_sql(_STATS_SQL, list(STAT_NAMES), 'z_')}), "
        f"zl AS (WITH lw AS ({_LEX_WIDE_SQL}) {_apply_sql('lw', LEX_COLS, 'z_')}), "
        f"en AS (SELECT e.*, d.split FROM {_encode_sql(_DOC_KEYS_SQL, ['doc_id'])} e JOIN {_DOC_KEYS_SQL} d "
        f"ON d.doc_id = e.doc_id WHERE {chosen}), "
        "mx AS (SELECT split, max(n_ids) AS m FROM en GROUP BY split) "
        "SELECT en.doc_id, en.split, en.input_ids || repeat(' 0', mx.m - en.n_ids) AS input_ids, "
        "trim(repeat('1 ', en.n_ids) || repeat('0 ', mx.m - en.n_ids)) AS attention_mask, "
        f"{zs}, {zl} FROM en JOIN mx ON mx.split = en.split JOIN zs ON zs.doc_id = en.doc_id JOIN zl ON zl.doc_id = en.doc_id)")


@register("labelled_samples",
          f"SELECT s.*, CAST(l.quality AS INTEGER) AS label FROM {_samples_sql('e.doc_id IN (SELECT doc_id FROM labels)')} s "
          "JOIN labels l ON l.doc_id = s.doc_id")
def labelled_samples(spark, sf):
    """Labelled samples: padded ids, mask, scaled statistics and lexicon counts."""
    return _samples(spark, sf, labelled=True)


@register("unlabelled_samples",
          f"SELECT s.* FROM {_samples_sql('e.doc_id NOT IN (SELECT doc_id FROM labels)')} s")
def unlabelled_samples(spark, sf):
    """The same for documents that carry no label."""
    return _samples(spark, sf, labelled=False)


@register("saved_vocabulary_lexicon",
          f"WITH {I.token_category_ctes(I.CLEANED_DOCS_SQL)}, voc AS {VOCAB_SQL} "
          "SELECT tc.tok AS token, voc.id, voc.n, tc.category FROM tc JOIN voc ON voc.token = tc.tok")
def saved_vocabulary_lexicon(spark, sf):
    """Vocabulary and lexicon saved as tables and reloaded: categories of each vocabulary token."""
    base = scratch_path(spark, "saved")
    EN.save_vocabulary(EN.vocabulary(I.spread_docs(spark, sf), "c"), f"{base}/vocabulary")
    LX.save_lexicon(_lexicon(spark), f"{base}/lexicon")
    voc = EN.load_vocabulary(spark, f"{base}/vocabulary")
    lex = LX.load_lexicon(spark, f"{base}/lexicon")
    words = voc.filter(F.col("token").rlike(f"^{LEXICON_TOKEN}$"))
    return LX.match_tokens(words, "token", lex).select("token", "id", "n", "category")
