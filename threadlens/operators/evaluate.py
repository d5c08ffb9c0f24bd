"""Classification metrics as aggregations.

Everything starts from per-class counts (at most C rows per group), built in
one shuffle with map-side partial aggregation; the metrics are arithmetic on
those few rows. Classes are the union of observed and predicted values, and
a zero denominator gives 0 (or null for AUC with one class present).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import running
from .util import broadcast_if_bounded, safe_div


def confusion(df: DataFrame, label: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, prediction, n)."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, label: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., cls, support, predicted, tp) for every class seen in either column.

    Derived from the confusion counts, at most C x C rows a group, which are then
    brought together by group; what follows by group needs no further exchange.
    """
    return counts_of(confusion(df, label, pred, by), by)


def counts_of(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``class_counts`` from confusion counts (by..., label, prediction, n)."""
    conf = conf.repartition(*by) if by else conf.coalesce(1)
    n, hit = F.col("n"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    rows = F.array(F.struct(F.col("label").alias("cls"), n.alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("t")),
                   F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("s"), n.alias("p"),
                            F.lit(0).cast("long").alias("t")))
    e = conf.select(*by, F.inline(rows))
    return e.groupBy(*by, "cls").agg(F.sum("s").cast("long").alias("support"),
                                     F.sum("p").cast("long").alias("predicted"),
                                     F.sum("t").cast("long").alias("tp"))


def per_class(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to class counts."""
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return counts.withColumns({
        "precision": safe_div(tp, p), "recall": safe_div(tp, s), "f1": safe_div(2 * tp, p + s)})


def binary_prf(df: DataFrame, label: str, pred: str, by: tuple[str, ...] = (),
               positive: int = 1) -> DataFrame:
    """Precision, recall and F1 of the positive class."""
    return prf_of(confusion(df, label, pred, by), by, positive)


def prf_of(conf: DataFrame, by: tuple[str, ...] = (), positive: int = 1) -> DataFrame:
    """``binary_prf`` from confusion counts (by..., label, prediction, n)."""
    y, yh = F.col("label") == positive, F.col("prediction") == positive
    g = conf.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for c, name in (
        (y & yh, "tp"), (~y & yh, "fp"), (y & ~yh, "fn"))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(*by, safe_div(tp, tp + fp).alias("precision"),
                    safe_div(tp, tp + fn).alias("recall"),
                    safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), "tp", "fp", "fn")


def micro_macro(df: DataFrame, label: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro precision (= accuracy) and macro precision, recall and F1."""
    return averages_of(class_counts(df, label, pred, by), by)


def averages_of(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``micro_macro`` from class counts."""
    return per_class(counts).groupBy(*by).agg(
        safe_div(F.sum("tp"), F.sum("predicted")).alias("micro_precision"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def class_report(df: DataFrame, label: str, pred: str, names: DataFrame | None = None,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``.

    ``names`` is a (cls, name) table, small and bounded by the class count;
    classes without a name are shown by number.
    """
    pc = per_class(class_counts(df, label, pred, by))
    if names is not None:
        pc = pc.join(broadcast_if_bounded(names, names.count()), "cls", "left")
    else:
        pc = pc.withColumn("name", F.lit(None).cast("string"))
    of_group = Window.partitionBy(*by)
    support, n = F.col("support"), F.sum("support").over(of_group)

    def weighted(c: str) -> Column:
        return safe_div(F.sum(F.col(c) * support).over(of_group), n)

    def row(name, precision, recall, f1, size) -> Column:
        return F.struct(name.alias("row"), precision.cast("double").alias("precision"),
                        recall.cast("double").alias("recall"), f1.cast("double").alias("f1"),
                        size.cast("long").alias("support"))

    null = F.lit(None)
    footers = (
        row(F.lit("accuracy"), null, null, safe_div(F.sum("tp").over(of_group), n), n),
        row(F.lit("macro avg"), *[F.avg(c).over(of_group) for c in ("precision", "recall", "f1")], n),
        row(F.lit("weighted avg"), *[weighted(c) for c in ("precision", "recall", "f1")], n))
    named = F.coalesce("name", F.col("cls").cast("string"))
    # the windows run over one group's classes; its first class row also carries the footers
    rows = pc.select(*by, row(named, F.col("precision"), F.col("recall"), F.col("f1"), support).alias("own"),
                     F.array(*footers).alias("foot"),
                     F.row_number().over(of_group.orderBy("cls")).alias("nth"))
    every = F.when(F.col("nth") == 1, F.concat(F.array("own"), "foot")).otherwise(F.array("own"))
    return rows.select(*by, F.inline(every))


def roc_auc(df: DataFrame, label: str, score: str, by: tuple[str, ...] = (),
            positive: int = 1) -> DataFrame:
    """Exact ROC AUC with ties counted half: (by..., auc, n_pos, n_neg).

    Rows collapse to one per distinct score (partial aggregation), then the
    negatives below each score come from a distributed running sum.
    """
    y = F.col(label) == positive
    g = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"))
    return auc_of(g, by)


def auc_of(g: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``roc_auc`` from the positives and negatives of each score (by..., _s, _p, _n)."""
    r = running(g, list(by), ["_s"], {"_nb": ("sum", F.col("_n"))}, inclusive=False)
    a = r.groupBy(*by).agg(
        F.sum(F.col("_p") * (F.col("_nb") + F.col("_n") * F.lit(0.5))).alias("_u"),
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    pn = F.col("n_pos") * F.col("n_neg")
    return a.select(*by, F.when(pn == 0, F.lit(None).cast("double"))
                    .otherwise(F.col("_u") / pn.cast("double")).alias("auc"), "n_pos", "n_neg")


def epoch_metrics(scored: DataFrame, label: str = "label", pred: str = "prediction",
                  score: str | None = "score", loss: str | None = "loss",
                  batched: DataFrame | None = None, batch: str = "batch_id",
                  by: tuple[str, ...] = ("split",), multiclass: bool = False) -> DataFrame:
    """One epoch's evaluation as long rows (by..., metric, value).

    Binary precision / recall / F1 and AUC (when ``score`` is given), or with
    ``multiclass`` micro precision and macro precision / recall / F1; and the
    loss: the mean of batch means when ``batched`` (the same rows with their
    ``batch``) is given, else the row mean. The record appended to the metrics
    table each epoch. All of it comes from one aggregate over grouping sets: label
    and prediction, score, batch.
    """
    rows = scored if batched is None else batched
    groups = [(label, "label"), (pred, "prediction")]
    sets = {"pairs": ["label", "prediction"]}
    if score is not None and not multiclass:
        groups.append((score, "_s"))
        sets["scores"] = ["_s"]
    if loss is not None:
        sets["losses"] = []
        if batched is not None:
            groups.append((batch, "_batch"))
            sets["losses"] = ["_batch"]
    names = [*by, *(alias for _, alias in groups)]
    value = F.lit(None).cast("double") if loss is None else F.col(loss)
    rows = rows.select(*by, *[F.col(c).alias(alias) for c, alias in groups], value.alias("_loss"))
    # one aggregate for all metrics; what it leaves is small and read several times
    totals = materialize(rows.groupingSets([[F.col(c) for c in (*by, *own)] for own in sets.values()], *names).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("_p"),
        F.avg("_loss").alias("_m")))

    def part(which: str) -> DataFrame:
        number = sum(1 << i for i, c in enumerate(reversed(names)) if c not in (*by, *sets[which]))
        return totals.filter(F.col("_set") == number)

    pairs = part("pairs").select(*by, "label", "prediction", "n")
    if multiclass:
        m, shown = averages_of(counts_of(pairs, by), by), ("micro_precision", "macro_precision", "macro_recall", "macro_f1")
    else:
        m, shown = prf_of(pairs, by), ("precision", "recall", "f1")
    out = m.select(*by, F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in shown])))
    if "scores" in sets:
        a = auc_of(part("scores").select(*by, "_s", "_p", (F.col("n") - F.col("_p")).alias("_n")), by)
        out = out.unionByName(a.select(*by, F.lit("auc").alias("metric"), F.col("auc").alias("value")))
    if loss is not None:
        mean = part("losses").groupBy(*by).agg(F.avg("_m").alias("value"))
        out = out.unionByName(mean.select(*by, F.lit("loss").alias("metric"), "value"))
    return out
