"""Registered queries: CSV split round trip, fitted-parameter tables,
a fitted classifier, and the stateless steps on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import NA_WORDS
from ..functions.text import STAT_NAMES
from ..operators.scaling import ScalerModel
from ..operators.score import FusionModel, fusion_scores
from ..session import materialize, scratch_path
from ..sources.splits import CSV_OPTIONS, read_flat_splits, read_splits, write_splits
from ..streaming import stateless as ST
from . import inputs as I
from . import sqltext as S
from .q_features import FIT_SPLITS, _lexicon, fit_both
from .q_score import FUSION, HEAD, _LOGITS_SQL, _fusion_sql, featurized
from .q_text import _stats_sql
from . import sqlmodel as M
from ..sources.tables import deal, read_table
from .registry import register

_NA_SQL = ", ".join(S.lit(w) for w in NA_WORDS)


@register("csv_roundtrip",
          f"SELECT d.id AS doc_id, d.split, CASE WHEN d.c IN ({_NA_SQL}) THEN NULL ELSE d.c END AS content_cleaned, "
          f"CAST(l.quality AS INTEGER) AS label FROM {I.CLEANED_DOCS_SQL} d LEFT JOIN labels l ON l.doc_id = d.id")
def csv_roundtrip(spark, sf):
    """Cleaned, labelled documents written as split CSV folders and read back."""
    d = I.cleaned_docs(spark, sf)
    lab = read_table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("label"))
    rows = d.join(lab, "doc_id", "left").select("doc_id", F.col("c").alias("content_cleaned"),
                                                "label", "split")
    path = write_splits(rows, scratch_path(spark, "splits"))
    back = read_splits(spark, path, "doc_id long, content_cleaned string, label int",
                       ("content_cleaned",))
    return back.select("doc_id", "split", "content_cleaned", "label")


@register("params_roundtrip", _fusion_sql())
def params_roundtrip(spark, sf):
    """Fitted scalers and model weights saved as parquet tables, reloaded,
    then used to score: same output as ``fusion_forward``."""
    f = materialize(featurized(spark, sf))
    base = scratch_path(spark, "params")
    for model, name in zip(fit_both(f.filter(F.col("split").isin(*FIT_SPLITS))), ("stats", "lexicon")):
        model.to_df(spark).write.parquet(f"{base}/scaler_{name}")
    FUSION.to_table(spark).write.parquet(f"{base}/weights")
    ms = ScalerModel.from_df(spark.read.parquet(f"{base}/scaler_stats"))
    ml = ScalerModel.from_df(spark.read.parquet(f"{base}/scaler_lexicon"))
    model = FusionModel.from_table(spark.read.parquet(f"{base}/weights"))
    x = f.select("doc_id", "split", "x", F.array(*[ms.column(n, n) for n in STAT_NAMES]).alias("zs"),
                 ml.array("lex_vec").alias("zl"))
    s = fusion_scores(x, model, "x", "zs", "zl", keep=("doc_id", "split"))
    return s.select("doc_id", "split", F.round(F.element_at("probs", 1), 6).alias("p0"),
                    F.round(F.element_at("probs", 2), 6).alias("p1"), "prediction",
                    F.round("score", 6).alias("score"))


@register("csv_flat_files",
          f"SELECT d.id AS doc_id, d.split, CASE WHEN d.c IN ({_NA_SQL}) THEN NULL ELSE d.c END AS content_cleaned, "
          f"CAST(l.quality AS INTEGER) AS label FROM {I.CLEANED_DOCS_SQL} d JOIN labels l ON l.doc_id = d.id")
def csv_flat_files(spark, sf):
    """Three flat files, each with its columns in another order and one column more, read by header name."""
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = I.cleaned_docs(spark, sf).join(lab, "doc_id").select(
        "doc_id", "split", F.col("c").alias("content_cleaned"), "label", F.lit("x").alias("extra"))
    base = scratch_path(spark, "flat")
    for split, order in (("train", ("label", "extra", "content_cleaned", "doc_id")),
                         ("validate", ("content_cleaned", "doc_id", "label", "extra")),
                         ("test", ("extra", "doc_id", "content_cleaned", "label"))):
        rows.filter(F.col("split") == split).select(*order).write.options(**CSV_OPTIONS).csv(f"{base}/{split}.csv")
    back = read_flat_splits(spark, base, "doc_id long, content_cleaned string, label int", ("content_cleaned",))
    return back.select("doc_id", "split", "content_cleaned", "label")


@register("csv_quoted_lines",
          f"SELECT doc_id, CASE WHEN text IN ({_NA_SQL}) THEN NULL ELSE text END AS text, n_chars, "
          f"CASE WHEN source IN ({_NA_SQL}) THEN NULL ELSE source END AS source FROM documents")
def csv_quoted_lines(spark, sf):
    """Raw documents, with their line breaks and quotes, as quoted CSV, read back line by line in parallel."""
    base = scratch_path(spark, "quoted")
    rows = read_table(spark, sf, "documents").select("doc_id", "text", "n_chars", "source")
    rows.write.options(**CSV_OPTIONS).csv(f"{base}/all.csv")
    back = read_flat_splits(spark, base, "doc_id long, text string, n_chars long, source string",
                            ("text", "source"), splits=("all",))
    return back.select("doc_id", "text", "n_chars", "source")


@register("fit_fused_classifier",
          f"SELECT d.doc_id, {I.split_sql('d.doc_id')} AS split, CAST(l.quality AS INTEGER) AS label, "
          "true AS score_in_range, true AS prediction_agrees FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def fit_fused_classifier(spark, sf):
    """Fit an L2-regularised logistic regression on hashed terms ‖ scaled
    statistics ‖ scaled lexicon counts (train split), score every split.

    Another optimiser than the reference's network for the same task, so scores
    differ; checked are the rows, that scores are probabilities and that
    predictions follow from them.
    """
    s = fused_classifier_scores(spark, sf)
    return s.select("doc_id", "split", "label", F.col("score").between(0.0, 1.0).alias("score_in_range"),
                    ((F.col("score") >= 0.5) == (F.col("prediction") == 1)).alias("prediction_agrees"))


REG = 1e-4
N_FEATURES = FUSION.content.shape[1] + len(STAT_NAMES) + FUSION.lexicon.shape[1]


def classifier_rows(spark, sf):
    """(doc_id, split, label, features array<double>) of the labelled documents, features scaled."""
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    f = materialize(featurized(spark, sf, lab))
    ms, ml = fit_both(f.filter(F.col("split").isin(*FIT_SPLITS)))
    return f.filter("label is not null").select(
        "doc_id", "split", "label",
        F.concat("x", F.array(*[ms.column(n, n) for n in STAT_NAMES]), ml.array("lex_vec")).alias("features"))


def fit_classifier(rows, label="label"):
    """Logistic regression with an L2 penalty, on the train split; run to convergence."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = rows.filter(F.col("split") == "train").select(F.col(label).alias("label"),
                                                      array_to_vector("features").alias("features"))
    # some hundred short passes over few numbers a row: tasks beyond the cores would only be scheduled
    x = x.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    return LogisticRegression(regParam=REG, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(x)


def fused_classifier_scores(spark, sf):
    """(doc_id, split, label, prediction, score) of the fitted classifier."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = classifier_rows(spark, sf)
    p = fit_classifier(rows).transform(rows.withColumn("features", array_to_vector("features")))
    return p.select("doc_id", "split", F.col("label").cast("int").alias("label"),
                    F.col("prediction").cast("int").alias("prediction"),
                    F.element_at(vector_to_array("probability"), -1).alias("score"))


def loss_gradient(rows, weights: list[float], intercept: float):
    """(feature, gradient) of the penalised mean loss on the train split: one aggregate; feature -1 is the intercept."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    z = F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(float(intercept)), lambda a, b: a + b)
    r = rows.filter(F.col("split") == "train").select("features", (1 / (1 + F.exp(-z)) - F.col("label")).alias("r"))
    parts = [F.avg(F.col("r") * F.element_at("features", i + 1)) + REG * float(v) for i, v in enumerate(weights)]
    g = r.agg(F.array(F.avg("r"), *parts).alias("g"))
    return g.select(F.posexplode("g").alias("at", "gradient")) \
        .select((F.col("at") - 1).cast("long").alias("feature"), "gradient")


@register("fit_certificate", f"SELECT feature::BIGINT AS feature, true AS optimal FROM range(-1, {N_FEATURES}) t(feature)")
def fit_certificate(spark, sf):
    """The fit is checked: with the fitted weights the gradient of the penalised loss, which has one optimum, is zero.

    Weights of an unfinished or wrong fit have larger gradients, and rows that differ from the oracle's.
    """
    rows = materialize(classifier_rows(spark, sf))
    model = fit_classifier(rows)
    g = loss_gradient(rows, model.coefficients.toArray().tolist(), model.intercept)
    return g.select("feature", (F.abs("gradient") < 1e-4).alias("optimal"))


_DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@register("stream_clean_stats",
          f"SELECT doc_id, c AS cleaned, {_stats_sql('c')} FROM "
          f"(SELECT doc_id, {S.clean('text')} AS c FROM documents)")
def stream_clean_stats(spark, sf):
    """Documents as a file stream -> cleaner + statistics -> parquet sink
    (availableNow, checkpointed), read back."""
    src = deal(ST.table_stream(spark, sf, "documents.parquet", _DOC_SCHEMA), ("doc_id",))
    out = ST.stream_text_features(src, "doc_id", "text")
    base = scratch_path(spark, "stream-text")
    ST.run_available_now(out, f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink")


@register("stream_fusion_scores", _fusion_sql())
def stream_fusion_scores(spark, sf):
    """Documents as a file stream -> cleaner -> features -> scalers fitted beforehand -> late fusion -> parquet sink."""
    ms, ml = fit_both(featurized(spark, sf).filter(F.col("split").isin(*FIT_SPLITS)))
    src = deal(ST.table_stream(spark, sf, "documents.parquet", _DOC_SCHEMA), ("doc_id",))
    src = src.select("doc_id", "text", I.split_of("doc_id").alias("split"))
    out = ST.stream_fusion_scores(src, "doc_id", "text", _lexicon(spark), ms, ml, FUSION, keep=("split",))
    base = scratch_path(spark, "stream-fusion")
    ST.run_available_now(out, f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink").select(
        "doc_id", "split", F.round(F.element_at("probs", 1), 6).alias("p0"),
        F.round(F.element_at("probs", 2), 6).alias("p1"), "prediction", F.round("score", 6).alias("score"))


_Z = [f"z{i}" for i in range(len(HEAD.bias))]


@register("stream_head_scores",
          f"SELECT vec_id, label, {M.argmax(_Z)} AS prediction, round({M.softmax(_Z)[-1]}, 6) AS prob_last "
          f"FROM {_LOGITS_SQL}")
def stream_head_scores(spark, sf):
    """Embeddings as a file stream -> ten-class head -> parquet sink, read back."""
    src = ST.table_stream(spark, sf, "embeddings.parquet", "vec_id long, embedding array<float>, label int")
    out = ST.stream_head_scores(src, HEAD, "vec_id", "embedding", keep=("label",))
    out = out.select("vec_id", "label", "prediction",
                     F.round(F.element_at("probs", -1), 6).alias("prob_last"))
    base = scratch_path(spark, "stream-head")
    ST.run_available_now(out, f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink")
