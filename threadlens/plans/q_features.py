"""Registered queries: lexicon features, null policy, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..functions.text import STAT_NAMES
from ..operators import lexicon as LX
from ..operators.scaling import ScalerModel, fit_array_scaler, fit_scaler
from ..session import materialize, scratch_path
from ..sources.lexicon_file import read_dic, write_dic
from . import inputs as I
from . import sqltext as S
from ..sources.tables import read_table
from .registry import register

FIT_SPLITS = ("train", "validate")
LEX_COLS = [f"lex_{c}" for c in I.LEXICON_CATEGORIES]


def fit_both(f):
    """Scalers of the statistics and of the lexicon vector, fitted in one aggregate."""
    features = {n: n for n in STAT_NAMES} | {c: F.element_at("lex_vec", i + 1) for i, c in enumerate(LEX_COLS)}
    m = ScalerModel.from_df(fit_scaler(f, features))
    n = len(STAT_NAMES)
    return (ScalerModel(m.features[:n], m.mean[:n], m.scale[:n]),
            ScalerModel(m.features[n:], m.mean[n:], m.scale[n:]))


def _lexicon(spark):
    return LX.lexicon_from_pairs(spark, I.LEXICON_PAIRS, list(I.LEXICON_CATEGORIES))


# --- tokens and matching -----------------------------------------------------

@register("lexicon_tokens",
          f"SELECT id AS doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens "
          f"FROM (SELECT id, {S.lexicon_tokens('c')} AS t FROM {I.CLEANED_DOCS_SQL})")
def lexicon_tokens(spark, sf):
    """Lower-cased Unicode word runs of each cleaned document (whole text)."""
    d = I.cleaned_docs(spark, sf)
    t = tf.lexicon_tokens("c")
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                    F.array_join(t, " ").alias("tokens"))


@register("lexicon_match",
          f"WITH {I.token_category_ctes(I.CLEANED_DOCS_SQL)} "
          "SELECT tok AS token, category FROM tc")
def lexicon_match(spark, sf):
    """Token -> category for every distinct token of the corpus."""
    lex = _lexicon(spark)
    d = I.cleaned_docs(spark, sf)
    toks = d.select(F.explode(tf.lexicon_tokens("c")).alias("token")).distinct()
    return LX.match_tokens(toks, "token", lex).select("token", "category")


_COUNTS_SQL = (f"WITH {I.token_category_ctes(I.CLEANED_DOCS_SQL)} "
               "SELECT toks.id AS doc_id, tc.category, CAST(count(*) AS BIGINT) AS n "
               "FROM toks JOIN tc ON toks.tok = tc.tok GROUP BY toks.id, tc.category")


@register("lexicon_counts", _COUNTS_SQL)
def lexicon_counts(spark, sf):
    """(doc_id, category, n): category counts over each cleaned document."""
    d = I.cleaned_docs(spark, sf)
    return LX.lexicon_counts(d, "doc_id", "c", _lexicon(spark))


def _vector_sql(select_tail: str) -> str:
    return (f"WITH {I.token_category_ctes(I.CLEANED_DOCS_SQL)}, "
            "cnt AS (SELECT toks.id, tc.category, count(*) AS n FROM toks JOIN tc "
            "ON toks.tok = tc.tok GROUP BY toks.id, tc.category), "
            f"cats AS {I.categories_sql()}, "
            "grid AS (SELECT d.id, d.split, cats.category, cats.ord, "
            "CAST(coalesce(cnt.n, 0) AS BIGINT) AS n FROM "
            f"(SELECT id, split FROM {I.CLEANED_DOCS_SQL}) d CROSS JOIN cats "
            "LEFT JOIN cnt ON cnt.id = d.id AND cnt.category = cats.category) "
            + select_tail)


@register("lexicon_vector", _vector_sql(
    "SELECT id AS doc_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY ord) AS lex_vec "
    "FROM grid GROUP BY id"))
def lexicon_vector(spark, sf):
    """Zero-filled category-count vector per document, dictionary order."""
    d = I.cleaned_docs(spark, sf)
    v = LX.lexicon_vector(d, "doc_id", "c", _lexicon(spark))
    return v.select("doc_id", F.array_join(F.transform("lex_vec", lambda x: x.cast("string")),
                                           ",").alias("lex_vec"))


@register("lexicon_projection", _vector_sql(
    "SELECT id AS doc_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY ord) AS lex_vec "
    "FROM grid GROUP BY id"))
def lexicon_projection(spark, sf):
    """The same vector computed inside the row: no exchange."""
    v = I.cleaned_docs(spark, sf).select("doc_id", LX.lexicon_array("c", _lexicon(spark)).alias("lex_vec"))
    return v.select("doc_id", F.array_join(F.transform("lex_vec", lambda x: x.cast("string")), ",").alias("lex_vec"))


@register("lexicon_from_file", _COUNTS_SQL)
def lexicon_from_file(spark, sf):
    """Same counts, with the lexicon written as a .dic file and read back."""
    path = scratch_path(spark, "lexicon")
    write_dic(spark, list(I.LEXICON_CATEGORIES), I.LEXICON_PAIRS, path)
    lex = read_dic(spark, path)
    d = I.cleaned_docs(spark, sf)
    return LX.lexicon_counts(d, "doc_id", "c", lex)


@register("lexicon_file_order", _vector_sql(
    "SELECT id AS doc_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY ord) AS lex_vec "
    "FROM grid GROUP BY id"))
def lexicon_file_order(spark, sf):
    """The vector of a .dic file whose category numbers fall: the order is that of its lines."""
    path = scratch_path(spark, "lexicon")
    n = len(I.LEXICON_CATEGORIES)
    write_dic(spark, list(I.LEXICON_CATEGORIES), I.LEXICON_PAIRS, path, numbers=[10 * (n - i) for i in range(n)])
    v = LX.lexicon_vector(I.cleaned_docs(spark, sf), "doc_id", "c", read_dic(spark, path))
    return v.select("doc_id", F.array_join(F.transform("lex_vec", lambda x: x.cast("string")), ",").alias("lex_vec"))


# --- nulls, splits -------------------------------------------------------------

@register("null_text_policy",
          "SELECT id, coalesce(text, '') AS filled, coalesce(text, 'nan') AS nan_text, "
          "(text IS NULL OR length(text) = 0) AS empty, "
          f"{S.char_count('text')} AS n_chars FROM {I.DOCS_EDGES_SQL}")
def null_text_policy(spark, sf):
    """Null text: filled with '', shown as 'nan' in compat mode, flagged empty."""
    d = I.documents_with_edges(spark, sf)
    return d.select("id", tf.fill_empty("text").alias("filled"),
                    tf.nan_string("text").alias("nan_text"),
                    tf.is_empty("text").alias("empty"), tf.char_count("text").alias("n_chars"))


def _labelled(spark, sf):
    d = I.documents(spark, sf).select("doc_id", I.split_of("doc_id").alias("split"))
    lab = read_table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("label"))
    return d.join(lab, "doc_id")


_LABELLED_SQL = (f"(SELECT d.doc_id, {I.split_sql('d.doc_id')} AS split, "
                 "CAST(l.quality AS INTEGER) AS label FROM documents d JOIN labels l "
                 "ON d.doc_id = l.doc_id)")


@register("split_union",
          f"SELECT doc_id, split, label FROM {_LABELLED_SQL} WHERE split = 'train' "
          f"UNION ALL SELECT doc_id, split, label FROM {_LABELLED_SQL} WHERE split = 'validate'")
def split_union(spark, sf):
    """Train and validate rows together, duplicates kept (UNION ALL)."""
    lab = _labelled(spark, sf)
    return lab.filter("split = 'train'").unionByName(lab.filter("split = 'validate'"))


@register("split_sizes",
          f"SELECT split, CAST(count(*) AS BIGINT) AS n_rows, "
          f"CAST(sum(label) AS BIGINT) AS n_positive FROM {_LABELLED_SQL} GROUP BY split")
def split_sizes(spark, sf):
    """Row count (and positives) per split."""
    return _labelled(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_positive"))


# --- scaling -------------------------------------------------------------------

def _stats_frame(spark, sf):
    d = I.cleaned_docs(spark, sf)
    return d.select("doc_id", "split", *tf.stat_columns("c"))


_STATS_SQL = (f"(SELECT id AS doc_id, split, "
              + ", ".join(f"{e} AS {n}" for e, n in zip(S.stat_exprs("c"), STAT_NAMES))
              + f" FROM {I.CLEANED_DOCS_SQL})")
_EPS = "2.220446049250313e-16"


def _fit_sql(src: str, cols: list[str], where: str) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS feature, {i} AS ord, avg(CAST({c} AS DOUBLE)) AS mean, "
            f"var_pop(CAST({c} AS DOUBLE)) AS var, count(*) AS n FROM {src} WHERE {where}")
    return ("(SELECT feature, ord, mean, CASE WHEN var <= n * " + _EPS + " * var + "
            f"pow(n * mean * {_EPS}, 2) THEN 1.0 ELSE sqrt(var) END AS scale, "
            "CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(parts) + "))")


_FIT_WHERE = "split IN ('train', 'validate')"


@register("scaler_fit_stats",
          "SELECT feature, ord, round(mean, 6) AS mean, round(scale, 6) AS scale, n FROM "
          + _fit_sql(_STATS_SQL, list(STAT_NAMES), _FIT_WHERE))
def scaler_fit_stats(spark, sf):
    """Mean and population scale of the six statistics on train+validate."""
    s = _stats_frame(spark, sf).filter(F.col("split").isin(*FIT_SPLITS))
    p = fit_scaler(s, {n: n for n in STAT_NAMES})
    return p.select("feature", "ord", F.round("mean", 6).alias("mean"),
                    F.round("scale", 6).alias("scale"), "n")


def _lex_frame(spark, sf):
    d = I.cleaned_docs(spark, sf)
    v = LX.lexicon_vector(d, "doc_id", "c", _lexicon(spark), carry=("split",))
    return v.select("doc_id", "split", *[F.element_at("lex_vec", i + 1).alias(c)
                                         for i, c in enumerate(LEX_COLS)])


_LEX_WIDE_SQL = _vector_sql(
    "SELECT id AS doc_id, split, "
    + ", ".join(f"sum(CASE WHEN ord = {i} THEN n ELSE 0 END) AS {c}" for i, c in enumerate(LEX_COLS))
    + " FROM grid GROUP BY id, split")


@register("scaler_fit_lexicon",
          f"WITH lw AS ({_LEX_WIDE_SQL}) SELECT feature, ord, round(mean, 6) AS mean, "
          f"round(scale, 6) AS scale, n FROM " + _fit_sql("lw", LEX_COLS, _FIT_WHERE))
def scaler_fit_lexicon(spark, sf):
    """Scaler over the category-count vector; absent categories count as 0."""
    d = I.cleaned_docs(spark, sf).filter(F.col("split").isin(*FIT_SPLITS))
    v = LX.lexicon_vector(d, "doc_id", "c", _lexicon(spark))
    p = fit_array_scaler(v, "lex_vec", LEX_COLS)
    return p.select("feature", "ord", F.round("mean", 6).alias("mean"),
                    F.round("scale", 6).alias("scale"), "n")


def _apply_sql(src: str, cols: list[str], prefix: str, rnd: bool = True) -> str:
    fit = _fit_sql(src, cols, _FIT_WHERE)
    r0, r1 = ("round(", ", 6)") if rnd else ("(", ")")
    sel = ", ".join(
        f"{r0}(CAST(s.{c} AS DOUBLE) - max(CASE WHEN f.feature = '{c}' THEN f.mean END)) / "
        f"max(CASE WHEN f.feature = '{c}' THEN f.scale END){r1} AS {prefix}{c}" for c in cols)
    return (f"SELECT s.doc_id, s.split, {sel} FROM {src} s CROSS JOIN {fit} f "
            "GROUP BY s.doc_id, s.split, " + ", ".join(f"s.{c}" for c in cols))


@register("scaler_apply", _apply_sql(_STATS_SQL, list(STAT_NAMES), "z_"))
def scaler_apply(spark, sf):
    """Statistics of every split, standardised with the train+validate fit.

    The fit is one global aggregate (six rows collected, like any fitted
    model); applying it is plain arithmetic in the same Project.
    """
    # seven longs per document: far smaller than the text, so keep them
    # rather than run the cleaner again for the apply pass
    s = materialize(_stats_frame(spark, sf))
    model = ScalerModel.from_df(fit_scaler(s.filter(F.col("split").isin(*FIT_SPLITS)),
                                           {n: n for n in STAT_NAMES}))
    return s.select("doc_id", "split", *[F.round(model.column(n, n), 6).alias(f"z_{n}")
                                         for n in STAT_NAMES])


@register("scaler_apply_lexicon",
          f"WITH lw AS ({_LEX_WIDE_SQL}) " + _apply_sql("lw", LEX_COLS, "z_"))
def scaler_apply_lexicon(spark, sf):
    """Category counts of every split, standardised element-wise as an array."""
    lf = _lex_frame(spark, sf)
    v = lf.select("doc_id", "split", F.array(*LEX_COLS).alias("lex_vec"))
    v = materialize(v)
    model = ScalerModel.from_df(fit_array_scaler(
        v.filter(F.col("split").isin(*FIT_SPLITS)), "lex_vec", LEX_COLS))
    z = model.array("lex_vec")
    return v.select("doc_id", "split", *[F.round(F.element_at(z, i + 1), 6).alias(f"z_{c}")
                                         for i, c in enumerate(LEX_COLS)])
