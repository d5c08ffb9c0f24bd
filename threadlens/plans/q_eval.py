"""Registered queries: confusion, P/R/F1 (binary, micro, macro), reports, AUC.

Binary task: a document's ``quality`` label against a length rule
(``n_chars >= 500``), score = ``n_chars``. Ten-class task: an embedding's
label against the ten-class head over all its components. Every split is
evaluated in the same pass (the split is part of each group key).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators.score import head_scores
from . import inputs as I
from . import sqlmodel as M
from .q_score import _LOGITS_SQL, _Z, HEAD, _emb
from ..sources.tables import read_table
from .registry import register

# Display names of the two post classes.
BINARY_NAMES = ((0, "WIP"), (1, "Complete"))


def binary_input(spark, sf):
    d = I.documents(spark, sf).select("doc_id", "n_chars")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id")
    return j.select("doc_id", I.split_of("doc_id").alias("split"),
                    F.col("quality").cast("int").alias("label"),
                    F.col("n_chars").cast("double").alias("score"),
                    F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("prediction"))


BINARY_SQL = (f"(SELECT d.doc_id, {I.split_sql('d.doc_id')} AS split, CAST(l.quality AS INTEGER) AS label, "
              "CAST(d.n_chars AS DOUBLE) AS score, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END "
              "AS prediction FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


def multi_input(spark, sf):
    """The ten-class head over the whole vector: its arg-max as the prediction."""
    return head_scores(_emb(spark, sf), HEAD, "x", keep=("vec_id", "split", "label")) \
        .select("vec_id", "split", "label", "prediction")


MULTI_SQL = f"(SELECT vec_id, split, label, {M.argmax(_Z)} AS prediction FROM {_LOGITS_SQL})"


def _class_counts_sql(src):
    return (f"cc AS (SELECT split, cls, CAST(sum(s) AS BIGINT) AS support, "
            f"CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS tp FROM ("
            f"SELECT split, label AS cls, 1 AS s, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS t "
            f"FROM {src} UNION ALL SELECT split, prediction, 0, 1, 0 FROM {src}) GROUP BY split, cls), "
            "pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted::DOUBLE END AS precision, "
            "CASE WHEN support = 0 THEN 0.0 ELSE tp / support::DOUBLE END AS recall, "
            "CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp / (predicted + support)::DOUBLE END AS f1 "
            "FROM cc)")


@register("confusion_matrix",
          f"SELECT split, label, prediction, count(*) AS n FROM {MULTI_SQL} GROUP BY ALL")
def confusion_matrix(spark, sf):
    """Ten-class confusion counts per split."""
    return E.confusion(multi_input(spark, sf), "label", "prediction", by=("split",))


@register("binary_prf",
          "SELECT split, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 9) AS precision, "
          "round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 9) AS recall, "
          "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 9) AS f1, "
          "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM (SELECT split, "
          "count_if(label = 1 AND prediction = 1) AS tp, "
          "count_if(label <> 1 AND prediction = 1) AS fp, count_if(label = 1 AND prediction <> 1) AS fn "
          f"FROM {BINARY_SQL} GROUP BY split)")
def binary_prf(spark, sf):
    """Binary precision, recall and F1 of the positive class, per split."""
    r = E.binary_prf(binary_input(spark, sf), "label", "prediction", by=("split",))
    return r.select("split", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                    "tp", "fp", "fn")


@register("multiclass_micro_macro",
          f"WITH {_class_counts_sql(MULTI_SQL)} SELECT split, "
          "round(CASE WHEN sum(predicted) = 0 THEN 0 ELSE sum(tp) / sum(predicted)::DOUBLE END, 9) AS micro_precision, "
          "round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, "
          "round(avg(f1), 9) AS macro_f1, count(*) AS n_classes FROM pc GROUP BY split")
def multiclass_micro_macro(spark, sf):
    """Micro precision and macro P/R/F1 over the union of classes, per split."""
    r = E.micro_macro(multi_input(spark, sf), "label", "prediction", by=("split",))
    return r.select("split", *[F.round(c, 9).alias(c) for c in
                               ("micro_precision", "macro_precision", "macro_recall", "macro_f1")],
                    "n_classes")


def _report_sql(src, names_sql):
    return (f"WITH {_class_counts_sql(src)}, nm AS {names_sql}, "
            "tot AS (SELECT split, sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, "
            "avg(f1) AS mf, sum(precision * support) AS wp, sum(recall * support) AS wr, "
            "sum(f1 * support) AS wf FROM pc GROUP BY split), "
            "rep AS (SELECT split, coalesce(nm.name, CAST(pc.cls AS VARCHAR)) AS row, precision, recall, f1, "
            "support FROM pc LEFT JOIN nm ON nm.cls = pc.cls "
            "UNION ALL SELECT split, 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0 ELSE tp / n::DOUBLE END, n FROM tot "
            "UNION ALL SELECT split, 'macro avg', mp, mr, mf, n FROM tot "
            "UNION ALL SELECT split, 'weighted avg', wp / n, wr / n, wf / n, n FROM tot) "
            "SELECT split, row, round(precision, 9) AS precision, round(recall, 9) AS recall, "
            "round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM rep")


def _rounded_report(r):
    return r.select("split", "row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


@register("class_report", _report_sql(
    MULTI_SQL, "(SELECT * FROM (VALUES (CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR))) t(cls, name) WHERE false)"))
def class_report(spark, sf):
    """Per-class precision/recall/F1/support and the three footer rows."""
    return _rounded_report(E.class_report(multi_input(spark, sf), "label", "prediction", by=("split",)))


_NAMES_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({c}, '{n}')" for c, n in BINARY_NAMES) + ") t(cls, name))"


@register("class_report_binary", _report_sql(BINARY_SQL, _NAMES_SQL))
def class_report_binary(spark, sf):
    """Binary report with class names joined from a small names table."""
    names = spark.createDataFrame(list(BINARY_NAMES), "cls int, name string")
    return _rounded_report(E.class_report(binary_input(spark, sf), "label", "prediction",
                                          names=names, by=("split",)))


@register("roc_auc",
          "WITH g AS (SELECT split, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, "
          f"sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS n FROM {BINARY_SQL} GROUP BY split, score), "
          "r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN "
          "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g) "
          "SELECT split, CASE WHEN sum(p) * sum(n) = 0 THEN NULL ELSE "
          "round(sum(p * (nb + 0.5::DOUBLE * n)) / (sum(p) * sum(n))::DOUBLE, 9) END AS auc, "
          "CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM r GROUP BY split")
def roc_auc(spark, sf):
    """Exact AUC (ties half) of n_chars as a quality score, per split."""
    r = E.roc_auc(binary_input(spark, sf), "label", "score", by=("split",))
    return r.select("split", F.round("auc", 9).alias("auc"), "n_pos", "n_neg")
