"""Run selection over an epoch history: best epoch, early stop, leaderboard.

History rows are (run, epoch, metric, ...). "Best so far" is a running max
of ``struct(metric, -epoch)``: a strictly greater metric replaces the best,
an equal one keeps the earlier epoch. NaN, null and values not above the
start value never improve (NaN sorts above everything in Spark, so it is
removed before the max).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import block_bucket, positions, running

START = -1.0


def best_so_far(hist: DataFrame, run: str = "run_id", epoch: str = "epoch",
                metric: str = "metric", start: float = START) -> DataFrame:
    """Add ``improved`` and ``best_epoch`` (so far) to every history row."""
    m = F.col(metric).cast("double")
    ok = m.isNotNull() & ~F.isnan(m) & (m > F.lit(start))
    cand = F.when(ok, F.struct(m.alias("m"), (-F.col(epoch)).alias("ne")))
    # epochs are dense per run: fixed blocks bucket them without sampling
    r = running(hist, [run], [epoch], {"_best": ("max", cand)}, bucket=block_bucket(epoch))
    return r.withColumns({
        "best_epoch": -F.col("_best.ne"),
        "improved": F.coalesce(-F.col("_best.ne") == F.col(epoch), F.lit(False)),
    }).drop("_best")


def early_stop(best: DataFrame, run: str = "run_id", epoch: str = "epoch",
               patience: int = 50, max_epochs: int = 300) -> DataFrame:
    """Per run: the first epoch with ``epoch - best_epoch >= patience`` (null
    if never), within the epoch cap, and the best epoch as of that point."""
    capped = best.filter(F.col(epoch) <= max_epochs)
    fired = F.col(epoch) - F.col("best_epoch") >= patience
    s = capped.groupBy(run).agg(
        F.min(F.when(fired, F.col(epoch))).alias("stop_epoch"),
        F.max(epoch).alias("last_epoch"))
    return s


def summarize(best: DataFrame, stops: DataFrame, cols: list[str], run: str = "run_id",
              epoch: str = "epoch", max_epochs: int = 300) -> DataFrame:
    """Values of ``cols`` at the best epoch, read at the stop epoch (a later
    improvement after patience fired does not count). Runs that never improve
    stay, with nulls."""
    j = best.join(stops, run).filter(
        (F.col(epoch) <= max_epochs)
        & (F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch"))))
    at = F.struct(F.col(epoch).alias("best_epoch"), *[F.col(c) for c in cols])
    last = F.max_by(F.when(F.col("improved"), at), F.when(F.col("improved"), F.col(epoch)))
    return j.groupBy(run, "stop_epoch").agg(last.alias("_b")).select(
        run, "stop_epoch", F.col("_b.best_epoch").alias("best_epoch"),
        *[F.col("_b").getField(c).alias(c) for c in cols])


def leaderboard(summary: DataFrame, metric: str, run: str = "run_id", k: int | None = None) -> DataFrame:
    """Every run with its ``rank`` by best metric (ties: smaller run id; runs without one last).

    With ``k`` only the top ones. Ranks are distributed positions, not one task's.
    """
    keyed = summary.withColumn("_order", F.coalesce(-F.col(metric), F.lit(float("inf"))))
    if k is not None:
        keyed = keyed.orderBy("_order", run).limit(k)
    return positions(keyed, [], ["_order", run], out="rank").drop("_order")
