"""Registered queries: linear heads, softmax, arg-max, losses, batches,
late-fusion scoring and a fitted classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..functions import arrays as A
from ..functions.text import STAT_NAMES
from ..operators import lexicon as LX
from ..operators.batches import assign_batches
from ..operators.hashing import hashed_array
from ..operators.evaluate import epoch_metrics
from ..operators.score import FusionModel, Linear, fusion_scores, head_scores, mean_batch_loss, rule_linear, row_losses
from . import inputs as I
from . import sqlmodel as M
from . import sqltext as S
from ..session import materialize
from .q_features import FIT_SPLITS, LEX_COLS, _apply_sql, _lexicon, fit_both, _LEX_WIDE_SQL, _STATS_SQL
from ..sources.tables import read_table
from .registry import register

EMB_DIM = 64
N_CLASSES = 10
HEAD = rule_linear(N_CLASSES, EMB_DIM, seed=7)
HIDDEN = rule_linear(10, EMB_DIM, seed=11)
BATCH_SIZE, SEED, EPOCH = 16, 42, 0

_EMB_IN = [f"embedding[{i + 1}]" for i in range(EMB_DIM)]


def _emb(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", I.split_of("vec_id").alias("split"),
                    F.col("label").cast("int").alias("label"),
                    F.col("embedding").cast("array<double>").alias("x"))


def _cols(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


@register("linear_relu",
          "SELECT vec_id, " + ", ".join(f"round({e}, 6) AS h{i}" for i, e in
                                        enumerate(M.relu(M.linear(_EMB_IN, HIDDEN))))
          + " FROM embeddings")
def linear_relu(spark, sf):
    """Content vector -> linear 64x10 -> ReLU."""
    h = _emb(spark, sf).select("vec_id", A.relu(A.linear("x", HIDDEN.weight, HIDDEN.bias)).alias("h"))
    return h.select("vec_id", *[F.round(F.element_at("h", i + 1), 6).alias(f"h{i}") for i in range(10)])


_LOGITS_SQL = ("(SELECT vec_id, " + I.split_sql("vec_id") + " AS split, CAST(label AS INTEGER) AS label, "
               + ", ".join(f"{e} AS z{i}" for i, e in enumerate(M.linear(_EMB_IN, HEAD)))
               + " FROM embeddings)")
_Z = _cols("z", N_CLASSES)


@register("softmax_scores",
          "SELECT vec_id, " + ", ".join(f"round({e}, 6) AS p{i}" for i, e in enumerate(M.softmax(_Z)))
          + f", round({M.softmax(_Z)[-1]}, 6) AS score FROM {_LOGITS_SQL}")
def softmax_scores(spark, sf):
    """Ten-class head: softmax probabilities and the last-column score."""
    s = head_scores(_emb(spark, sf), HEAD, "x", keep=("vec_id",))
    return s.select("vec_id", *[F.round(F.element_at("probs", i + 1), 6).alias(f"p{i}")
                                for i in range(N_CLASSES)],
                    F.round(A.last_score("probs"), 6).alias("score"))


@register("argmax_class",
          f"SELECT vec_id, label, {M.argmax(_Z)} AS prediction, "
          f"({M.argmax(_Z)}) = label AS correct FROM {_LOGITS_SQL}")
def argmax_class(spark, sf):
    """Predicted class = first maximum of the logits."""
    s = head_scores(_emb(spark, sf), HEAD, "x", keep=("vec_id", "label"))
    return s.select("vec_id", "label", "prediction", (F.col("prediction") == F.col("label")).alias("correct"))


_LSE = f"(greatest({', '.join(_Z)}) + ln(0.0::DOUBLE + " + " + ".join(
    f"exp({z} - greatest({', '.join(_Z)}))" for z in _Z) + "))"
_ZL = "CASE label " + " ".join(f"WHEN {i} THEN {z}" for i, z in enumerate(_Z)) + " END"
_LOSS_SQL = f"(SELECT vec_id, split, label, {_LSE} - {_ZL} AS loss FROM {_LOGITS_SQL})"


@register("cross_entropy_rows", f"SELECT vec_id, label, round(loss, 6) AS loss FROM {_LOSS_SQL}")
def cross_entropy_rows(spark, sf):
    """Cross-entropy of each row's logits against its label."""
    s = row_losses(head_scores(_emb(spark, sf), HEAD, "x", keep=("vec_id", "label")), "label")
    return s.select("vec_id", "label", F.round("loss", 6).alias("loss"))


def _order_sql(id_expr):
    return (f"CASE WHEN split = 'train' THEN md5(concat_ws(':', CAST({id_expr} AS VARCHAR), "
            f"'{SEED}', '{EPOCH}')) ELSE '' END, {id_expr}")


@register("mean_batch_loss",
          "WITH b AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY "
          f"{_order_sql('vec_id')}) - 1) // {BATCH_SIZE} AS batch_id FROM {_LOSS_SQL}), "
          "bm AS (SELECT split, batch_id, avg(loss) AS m, sum(loss) AS s, count(*) AS n FROM b GROUP BY ALL) "
          "SELECT split, round(avg(m), 6) AS mean_batch_loss, round(sum(s) / sum(n), 6) AS row_mean_loss, "
          "count(*) AS n_batches FROM bm GROUP BY split")
def mean_batch_loss_q(spark, sf):
    """Per split: mean of batch-mean losses (batches of 16, train shuffled)."""
    s = row_losses(head_scores(_emb(spark, sf), HEAD, "x", keep=("vec_id", "split", "label")), "label")
    b = assign_batches(s, "vec_id", batch_size=BATCH_SIZE, seed=SEED, epoch=EPOCH)
    r = mean_batch_loss(b, "loss", "batch_id", by=("split",))
    return r.select("split", F.round("mean_batch_loss", 6).alias("mean_batch_loss"),
                    F.round("row_mean_loss", 6).alias("row_mean_loss"), "n_batches")


@register("batch_assignment",
          f"SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY {_order_sql('doc_id')}) AS pos, "
          f"(row_number() OVER (PARTITION BY split ORDER BY {_order_sql('doc_id')}) - 1) // {BATCH_SIZE} "
          f"AS batch_id FROM (SELECT doc_id, {I.split_sql('doc_id')} AS split FROM documents)")
def batch_assignment(spark, sf):
    """Seeded shuffle of the train split, batches of 16, last one partial."""
    d = I.documents(spark, sf).select("doc_id", I.split_of("doc_id").alias("split"))
    return assign_batches(d, "doc_id", batch_size=BATCH_SIZE, seed=SEED, epoch=EPOCH) \
        .select("doc_id", "split", "pos", "batch_id")


# --- late fusion over documents --------------------------------------------

FUSION = FusionModel.from_rule(EMB_DIM, len(I.LEXICON_CATEGORIES), 2, seed=3)


def featurized(spark, sf, labels=None):
    """(doc_id, split, stats..., lex_vec, x): statistics, lexicon counts, and the hashed term
    frequencies that stand for the content, in one projection of the cleaned text.

    With ``labels`` (doc_id, label) a column ``label`` follows, null where a document has none;
    such a document serves the scalers only, so its x is null.
    """
    d, lex = I.spread_docs(spark, sf), _lexicon(spark)
    if labels is None:
        return d.select("doc_id", "split", *feature_columns("c", lex))
    *others, x = feature_columns("c", lex)
    return d.join(labels, "doc_id", "left").select(
        "doc_id", "split", *others, F.when(F.col("label").isNotNull(), x).alias("x"), "label")


def feature_columns(text, lex):
    return [*tf.stat_columns(text), LX.lexicon_array(text, lex).alias("lex_vec"),
            hashed_array(text, EMB_DIM).alias("x")]


def scaled_features(spark, sf):
    f = materialize(featurized(spark, sf))
    ms, ml = fit_both(f.filter(F.col("split").isin(*FIT_SPLITS)))
    return f.select("doc_id", "split", "x",
                    F.array(*[ms.column(n, n) for n in STAT_NAMES]).alias("zs"),
                    ml.array("lex_vec").alias("zl"))


_TF_SQL = (
    "(SELECT id AS doc_id, " + ", ".join(
        f"CASE WHEN count(b) = 0 THEN 0.0::DOUBLE ELSE count_if(b = {i}) / count(b)::DOUBLE END AS c{i}"
        for i in range(EMB_DIM))
    + f" FROM (SELECT id, CASE WHEN tok IS NOT NULL THEN ('0x' || substr(md5(tok), 1, 4))::INTEGER % {EMB_DIM} END AS b "
    f"FROM (SELECT id, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS tok FROM "
    f"(SELECT id, {S.lexicon_tokens('c')} AS t FROM {I.CLEANED_DOCS_SQL}))) GROUP BY id)")


def _fusion_sql(with_logits: bool = False):
    zs = [f"zs.z_{n}" for n in STAT_NAMES]
    zl = [f"zl.z_{c}" for c in LEX_COLS]
    emb = [f"tf.c{i}" for i in range(EMB_DIM)]
    hc = M.relu(M.linear(emb, FUSION.content))
    hs = M.relu(M.linear(zs, FUSION.stats))
    hl = M.relu(M.linear(zl, FUSION.lexicon))
    h = [f"h{i}" for i in range(len(hc) + len(hs) + len(hl))]
    fu = [f"f{i}" for i in range(len(FUSION.fusion.bias))]
    z = ["o0", "o1"]
    p = M.softmax(z)
    l1 = ("SELECT zs.doc_id, zs.split, " + ", ".join(f"{e} AS {n}" for e, n in zip(hc + hs + hl, h))
          + " FROM zs JOIN zl ON zs.doc_id = zl.doc_id JOIN tf ON tf.doc_id = zs.doc_id")
    l2 = "SELECT doc_id, split, " + ", ".join(
        f"{e} AS {n}" for e, n in zip(M.relu(M.linear(h, FUSION.fusion)), fu)) + f" FROM ({l1})"
    l3 = "SELECT doc_id, split, " + ", ".join(
        f"{e} AS {n}" for e, n in zip(M.linear(fu, FUSION.out), z)) + f" FROM ({l2})"
    return (f"WITH zs AS ({_apply_sql(_STATS_SQL, list(STAT_NAMES), 'z_', rnd=False)}), "
            f"zl AS (WITH lw AS ({_LEX_WIDE_SQL}) {_apply_sql('lw', LEX_COLS, 'z_', rnd=False)}), "
            f"tf AS {_TF_SQL} "
            + (f"SELECT doc_id, split, o0, o1, {p[1]} AS p1, {M.argmax(p)} AS prediction FROM ({l3})"
               if with_logits else
               f"SELECT doc_id, split, round({p[0]}, 6) AS p0, round({p[1]}, 6) AS p1, "
               f"{M.argmax(p)} AS prediction, round({p[1]}, 6) AS score FROM ({l3})"))


@register("fusion_forward", _fusion_sql())
def fusion_forward(spark, sf):
    """Late-fusion scores: content 64->10, statistics 6->3, lexicon L->20,
    fusion 33->10, output 2, softmax; features standardised on train+val."""
    s = fusion_scores(scaled_features(spark, sf), FUSION, "x", "zs", "zl", keep=("doc_id", "split"))
    return s.select("doc_id", "split", F.round(F.element_at("probs", 1), 6).alias("p0"),
                    F.round(F.element_at("probs", 2), 6).alias("p1"), "prediction",
                    F.round("score", 6).alias("score"))


def _epoch_sql():
    lse = "(greatest(o0, o1) + ln(0.0::DOUBLE + exp(o0 - greatest(o0, o1)) + exp(o1 - greatest(o0, o1))))"
    return (
        f"WITH f AS ({_fusion_sql(with_logits=True)}), "
        f"s AS (SELECT f.doc_id, f.split, f.p1 AS score, f.prediction, CAST(l.quality AS INTEGER) AS label, "
        f"{lse} - CASE WHEN l.quality = 0 THEN o0 ELSE o1 END AS loss "
        "FROM f JOIN labels l ON l.doc_id = f.doc_id), "
        f"b AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY {_order_sql('doc_id')}) - 1) "
        f"// {BATCH_SIZE} AS batch_id FROM s), "
        "prf AS (SELECT split, count_if(label = 1 AND prediction = 1) AS tp, "
        "count_if(label <> 1 AND prediction = 1) AS fp, count_if(label = 1 AND prediction <> 1) AS fn "
        "FROM s GROUP BY split), "
        "g AS (SELECT split, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, "
        "sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS n FROM s GROUP BY split, score), "
        "r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g), "
        "auc AS (SELECT split, CASE WHEN sum(p) * sum(n) = 0 THEN NULL ELSE "
        "sum(p * (nb + 0.5::DOUBLE * n)) / (sum(p) * sum(n))::DOUBLE END AS v FROM r GROUP BY split), "
        "bl AS (SELECT split, avg(m) AS v FROM (SELECT split, batch_id, avg(loss) AS m FROM b "
        "GROUP BY split, batch_id) GROUP BY split) "
        "SELECT split, metric, round(value, 9) AS value FROM ("
        "SELECT split, 'precision' AS metric, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS value FROM prf "
        "UNION ALL SELECT split, 'recall', CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END FROM prf "
        "UNION ALL SELECT split, 'f1', CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END FROM prf "
        "UNION ALL SELECT split, 'auc', v FROM auc UNION ALL SELECT split, 'loss', v FROM bl)")


@register("fusion_epoch_metrics", _epoch_sql())
def fusion_epoch_metrics(spark, sf):
    """One epoch's record: score every split with the fusion model, then
    precision / recall / F1 / AUC and the mean of batch-mean losses per split
    as long (split, metric, value) rows."""
    s = fusion_scores(scaled_features(spark, sf), FUSION, "x", "zs", "zl", keep=("doc_id", "split"))
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    # a few numbers per document, read by every metric pass: keep them
    j = s.join(lab, "doc_id").select(
        "doc_id", "split", "label", "prediction", "score",
        A.cross_entropy("logits", "label").alias("loss"))
    j = materialize(j)
    # only the loss needs the batches
    b = assign_batches(j, "doc_id", batch_size=BATCH_SIZE, seed=SEED, epoch=EPOCH)
    m = epoch_metrics(j, batched=b)
    return m.select("split", "metric", F.round("value", 9).alias("value"))


# --- the reply classifier's epochs: ten-class heads of several runs ------------

#: Runs: seed and weight decay; an epoch's head follows from both.
REPLY_RUNS, REPLY_EPOCHS = ((7, 0.001), (8, 0.1)), 2


def reply_head(seed: int, weight_decay: float, epoch: int) -> Linear:
    lin = rule_linear(N_CLASSES, EMB_DIM, seed + 10 * (epoch - 1))
    keep = (1 - weight_decay) ** epoch
    return Linear([[round(w * keep, 6) for w in row] for row in lin.weight], lin.bias)


#: Runs that differ in model, seed, learning rate and weight decay.
GRID_RUNS = (("small", 7, 1e-05, 0.001), ("small", 8, 2e-05, 0.1), ("large", 9, 1e-05, 0.01), ("large", 7, 5e-05, 0.001),
             ("wide", 11, 3e-05, 0.05))


def grid_head(model: str, seed: int, lr: float, weight_decay: float, epoch: int) -> Linear:
    """The head of a run's epoch: a larger rate moves it further from its model's start."""
    lin, start = reply_head(seed, weight_decay, epoch), rule_linear(N_CLASSES, EMB_DIM, len(model))
    step = min(1.0, lr * 2e4 * epoch)
    return Linear([[round(a + step * (b - a), 6) for a, b in zip(r, t)] for r, t in zip(start.weight, lin.weight)], lin.bias)


def _reply_logits_sql(head: Linear) -> str:
    return ("(SELECT vec_id, " + I.split_sql("vec_id") + " AS split, CAST(label AS INTEGER) AS label, "
            + ", ".join(f"{e} AS z{i}" for i, e in enumerate(M.linear(_EMB_IN, head))) + " FROM embeddings)")


def reply_metrics_sql(head: Linear) -> str:
    """Long (split, metric, value) rows of one head's epoch record."""
    return (
        f"(WITH s AS (SELECT vec_id, split, label, {M.argmax(_Z)} AS prediction, {_LSE} - {_ZL} AS loss "
        f"FROM {_reply_logits_sql(head)}), "
        "cc AS (SELECT split, cls, sum(su) AS support, sum(p) AS predicted, sum(t) AS tp FROM ("
        "SELECT split, label AS cls, 1 AS su, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS t FROM s "
        "UNION ALL SELECT split, prediction, 0, 1, 0 FROM s) GROUP BY split, cls), "
        "pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted::DOUBLE END AS pr, "
        "CASE WHEN support = 0 THEN 0.0 ELSE tp / support::DOUBLE END AS re, "
        "CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp / (predicted + support)::DOUBLE END AS f FROM cc), "
        "m AS (SELECT split, sum(tp) / sum(predicted)::DOUBLE AS mp, avg(pr) AS ap, avg(re) AS ar, avg(f) AS af "
        "FROM pc GROUP BY split), "
        f"b AS (SELECT split, loss, (row_number() OVER (PARTITION BY split ORDER BY {_order_sql('vec_id')}) - 1) "
        f"// {BATCH_SIZE} AS batch_id FROM s), "
        "l AS (SELECT split, avg(x) AS v FROM (SELECT split, batch_id, avg(loss) AS x FROM b GROUP BY ALL) GROUP BY split) "
        "SELECT split, 'micro_precision' AS metric, mp AS value FROM m UNION ALL "
        "SELECT split, 'macro_precision', ap FROM m UNION ALL SELECT split, 'macro_recall', ar FROM m UNION ALL "
        "SELECT split, 'macro_f1', af FROM m UNION ALL SELECT split, 'loss', v FROM l)")


def reply_records(spark, sf, heads: list[Linear]):
    """Score every embedding with each head, and their epoch records per split: (head, split, metric, value).

    One scan and one job for all heads, a bounded number: each row carries its prediction and loss
    for every head, and is a row a head only where the counts are taken.
    """
    x = _emb(spark, sf)
    logits = [head("x").alias(f"z{i}") for i, head in enumerate(heads)]
    z = x.select("vec_id", "split", "label", *logits)
    found = [F.struct(F.lit(i).alias("head"), A.argmax(f"z{i}").alias("prediction"),
                      A.cross_entropy(f"z{i}", "label").alias("loss")) for i in range(len(heads))]
    s = materialize(z.select("vec_id", "split", "label", F.array(*found).alias("found")))
    b = assign_batches(s, "vec_id", batch_size=BATCH_SIZE, seed=SEED, epoch=EPOCH)
    b = b.select("split", "label", "batch_id", F.inline("found"))
    return epoch_metrics(b, batched=b, multiclass=True, by=("head", "split"))


def reply_record(spark, sf, head: Linear):
    """Score every embedding with the head, and the epoch's record per split."""
    return reply_records(spark, sf, [head]).drop("head")


@register("reply_epoch_metrics",
          f"SELECT split, metric, round(value, 9) AS value FROM {reply_metrics_sql(reply_head(7, 0.001, 1))}")
def reply_epoch_metrics(spark, sf):
    """The multi-class epoch record: micro precision, macro P / R / F1 and the loss, per split."""
    m = reply_record(spark, sf, reply_head(7, 0.001, 1))
    return m.select("split", "metric", F.round("value", 9).alias("value"))
