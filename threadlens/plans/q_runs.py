"""Registered queries: best epoch, early stop, metrics at the best epoch,
leaderboard, epoch times, and the run log / metrics table round trips.

History: Spark derives one row per (run, epoch) from ``events``: run = user,
epoch = the user's n-th active day; validation metric = share of purchase
events that day, test metric = share of clicks, loss = mean value. The
aggregation comes first, so a very active user adds days, not rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators.util import broadcast_if_bounded
from ..session import scratch_path
from ..sources import runlog
from ..sources.tables import read_table
from .q_score import GRID_RUNS, REPLY_EPOCHS, REPLY_RUNS, grid_head, reply_head, reply_metrics_sql, reply_records
from .registry import register

PATIENCE, MAX_EPOCHS = 3, 300


def history(spark, sf):
    e = read_table(spark, sf, "events")
    d = e.groupBy(F.col("user_id").alias("run_id"), F.to_date("ts").alias("day")).agg(
        (F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("metric"),
        (F.count_if(F.col("event_type") == "click") / F.count(F.lit(1))).alias("test_metric"),
        F.avg("value").alias("loss"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    # per-run window over days (bounded by the number of days, not events)
    return d.withColumn("epoch", F.row_number().over(Window.partitionBy("run_id").orderBy("day")).cast("long"))


HISTORY_SQL = (
    "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY day) AS epoch FROM ("
    "SELECT user_id AS run_id, CAST(ts AS DATE) AS day, "
    "count_if(event_type = 'purchase') / count(*)::DOUBLE AS metric, "
    "count_if(event_type = 'click') / count(*)::DOUBLE AS test_metric, "
    "avg(value) AS loss, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY ALL))")

BEST_SQL = (
    "(SELECT *, coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch "
    "ROWS UNBOUNDED PRECEDING), NULL) AS best_epoch FROM ("
    "SELECT *, (metric IS NOT NULL AND NOT isnan(metric) AND metric > -1 AND metric > coalesce("
    "max(CASE WHEN metric IS NOT NULL AND NOT isnan(metric) AND metric > -1 THEN metric END) OVER ("
    f"PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) "
    f"AS improved FROM {HISTORY_SQL}))")


@register("best_epoch",
          "SELECT run_id, epoch, round(metric, 9) AS metric, improved, best_epoch FROM " + BEST_SQL)
def best_epoch(spark, sf):
    """Per run and epoch: did the metric improve, and the best epoch so far."""
    b = R.best_so_far(history(spark, sf))
    return b.select("run_id", "epoch", F.round("metric", 9).alias("metric"), "improved", "best_epoch")


STOP_SQL = (f"(SELECT run_id, min(CASE WHEN epoch - best_epoch >= {PATIENCE} THEN epoch END) AS stop_epoch, "
            f"max(epoch) AS last_epoch FROM {BEST_SQL} WHERE epoch <= {MAX_EPOCHS} GROUP BY run_id)")


@register("early_stop",
          f"SELECT s.run_id, s.stop_epoch, s.last_epoch, (SELECT max(b.best_epoch) FROM {BEST_SQL} b "
          "WHERE b.run_id = s.run_id AND b.epoch <= coalesce(s.stop_epoch, s.last_epoch)) AS best_epoch "
          f"FROM {STOP_SQL} s")
def early_stop(spark, sf):
    """First epoch at which patience ran out, and the best epoch at that point."""
    b = R.best_so_far(history(spark, sf))
    s = R.early_stop(b, patience=PATIENCE, max_epochs=MAX_EPOCHS)
    j = b.join(s, "run_id").filter(F.col("epoch") <= F.coalesce("stop_epoch", "last_epoch"))
    at = j.groupBy("run_id", "stop_epoch", "last_epoch").agg(F.max("best_epoch").alias("best_epoch"))
    return at


SUMMARY_SQL = (
    f"(SELECT s.run_id, s.stop_epoch, t.best_epoch, t.best_metric, t.test_metric, t.loss FROM {STOP_SQL} s LEFT JOIN ("
    f"SELECT b.run_id, b.epoch AS best_epoch, b.metric AS best_metric, b.test_metric, b.loss "
    f"FROM {BEST_SQL} b JOIN {STOP_SQL} s ON b.run_id = s.run_id "
    "WHERE b.improved AND b.epoch <= coalesce(s.stop_epoch, s.last_epoch) "
    "QUALIFY row_number() OVER (PARTITION BY b.run_id ORDER BY b.epoch DESC) = 1) t ON t.run_id = s.run_id)")


def _summary(spark, sf):
    b = R.best_so_far(history(spark, sf))
    s = R.early_stop(b, patience=PATIENCE, max_epochs=MAX_EPOCHS)
    return R.summarize(b, s.select("run_id", "stop_epoch"),
                       ["metric", "test_metric", "loss"], max_epochs=MAX_EPOCHS) \
        .withColumnRenamed("metric", "best_metric")


@register("best_test_at_best_val",
          "SELECT run_id, stop_epoch, best_epoch, round(best_metric, 9) AS best_metric, "
          f"round(test_metric, 9) AS test_metric, round(loss, 6) AS loss FROM {SUMMARY_SQL}")
def best_test_at_best_val(spark, sf):
    """Validation metric, test metric and loss at each run's best epoch."""
    s = _summary(spark, sf)
    return s.select("run_id", "stop_epoch", "best_epoch", F.round("best_metric", 9).alias("best_metric"),
                    F.round("test_metric", 9).alias("test_metric"), F.round("loss", 6).alias("loss"))


@register("run_leaderboard",
          "SELECT row_number() OVER (ORDER BY best_metric DESC NULLS LAST, run_id) AS rank, run_id, "
          f"round(best_metric, 9) AS best_metric, best_epoch FROM {SUMMARY_SQL}")
def run_leaderboard(spark, sf):
    """Every run by best validation metric."""
    lb = R.leaderboard(_summary(spark, sf), "best_metric")
    return lb.select(F.col("rank").cast("long").alias("rank"), "run_id",
                     F.round("best_metric", 9).alias("best_metric"), "best_epoch")


@register("epoch_elapsed",
          "SELECT run_id, epoch, round(date_diff('microsecond', t0, t1) / 1e6, 6) AS elapsed_sec "
          f"FROM {HISTORY_SQL}")
def epoch_elapsed(spark, sf):
    """Seconds between the first and last logged time of each epoch."""
    h = history(spark, sf)
    # timestampdiff works on the stored wall-clock values: no session time zone
    us = F.expr("timestampdiff(MICROSECOND, t0, t1)")
    return h.select("run_id", "epoch", F.round(us / F.lit(1e6), 6).alias("elapsed_sec"))


# --- run logs: a log a run, the runs being twenty groups of users ----------------

_LOG_RUNS = 20


def logged_history(spark, sf):
    """One row per (run, epoch): run = group of users, epoch = the group's n-th active day."""
    e = read_table(spark, sf, "events")
    d = e.groupBy((F.col("user_id") % _LOG_RUNS).alias("run"), F.to_date("ts").alias("day")).agg(
        (F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("recall"),
        F.avg("value").alias("loss"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))
    return d.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("day")).cast("long"))


_LOGGED_SQL = (
    "(SELECT *, row_number() OVER (PARTITION BY run ORDER BY day) AS epoch FROM ("
    f"SELECT user_id % {_LOG_RUNS} AS run, CAST(ts AS DATE) AS day, "
    "count_if(event_type = 'purchase') / count(*)::DOUBLE AS recall, avg(value) AS loss, count(*) AS n "
    "FROM events GROUP BY ALL))")


def _report(n):
    """A class report as the log has it: a title line and indented lines."""
    return F.concat(F.lit("\n                precision    recall\n\n           1       0.50      0.25\n    accuracy  "), n)


@register("metrics_from_log",
          "WITH h AS " + _LOGGED_SQL + ", r AS (SELECT 'model' || (run % 5) AS model, run % 4 AS seed, '1e-05' AS lr, "
          "0.001::DOUBLE AS weight_decay, * FROM h) "
          "SELECT model, seed, lr, weight_decay, epoch, key, value_text FROM ("
          "SELECT model, seed, lr, weight_decay, epoch, 'Epoch' AS key, CAST(epoch AS VARCHAR) AS value_text FROM r "
          "UNION ALL SELECT model, seed, lr, weight_decay, epoch, 'Train loss', printf('%.6f', loss) FROM r "
          "UNION ALL SELECT model, seed, lr, weight_decay, epoch, 'Best val macro_recall', printf('%.6f', recall) FROM r "
          "UNION ALL SELECT model, seed, lr, weight_decay, epoch, 'Best val clf_report', '               precision    recall' "
          "|| chr(10) || chr(10) || '           1       0.50      0.25' || chr(10) || '    accuracy  ' || n FROM r "
          "UNION ALL SELECT model, seed, lr, weight_decay, epoch, 'time', n || '.2500s' FROM r "
          "UNION ALL SELECT DISTINCT model, seed, lr, weight_decay, NULL, 'arguments', 'seed=' || seed || ', lr=1e-05' FROM r)")
def metrics_from_log(spark, sf):
    """Write a log a run, with arguments, epochs and class reports; parse the files back."""
    return _logs(spark, sf).select("model", "seed", "lr", "weight_decay", "epoch", "key", "value_text")


def _logs(spark, sf):
    h = logged_history(spark, sf)
    model, seed = F.concat(F.lit("model"), (F.col("run") % 5).cast("string")), F.col("run") % 4
    h = h.withColumn("log", runlog.run_name(model, seed, "1e-05", "0.001"))
    args = F.concat(F.lit("Namespace(seed="), seed.cast("string"), F.lit(", lr=1e-05)"))
    first = h.filter("epoch = 1").withColumn("epoch", F.lit(0).cast("long"))
    records = runlog.format_records(first, ["log", "epoch"], "at", "run", [args]).unionByName(
        runlog.format_records(h, ["log", "epoch"], "at", "run", [
            F.concat(F.lit("Epoch: "), F.col("epoch").cast("string")),
            F.concat(F.lit("Train loss: "), F.format_string("%.6f", "loss")),
            F.concat(F.lit("Best val macro_recall: "), F.format_string("%.6f", "recall")),
            F.concat(F.lit("Best val clf_report:"), _report(F.col("n").cast("string"))),
            F.concat(F.lit("time: "), F.col("n").cast("string"), F.lit(".2500s\n"))]))
    path = runlog.write_logs(records, "log", ["epoch", "nth"], scratch_path(spark, "logs"))
    return runlog.read_logs(spark, path)


_LOG_METRICS_SQL = (
    "(WITH h AS " + _LOGGED_SQL + ", r AS (SELECT 'model' || (run % 5) AS model, run % 4 AS seed, '1e-05' AS lr, "
    "0.001::DOUBLE AS weight_decay, epoch, printf('%.6f', loss)::DOUBLE AS loss, "
    "printf('%.6f', recall)::DOUBLE AS recall, n FROM h) "
    "SELECT model, seed, lr, weight_decay, epoch, 'train' AS split, 'loss' AS metric, loss AS value FROM r "
    "UNION ALL SELECT model, seed, lr, weight_decay, epoch, 'validate', 'macro_recall', recall FROM r "
    "UNION ALL SELECT model, seed, lr, weight_decay, epoch, 'validate', '1/precision', 0.5 FROM r "
    "UNION ALL SELECT model, seed, lr, weight_decay, epoch, 'validate', '1/recall', 0.25 FROM r "
    "UNION ALL SELECT model, seed, lr, weight_decay, epoch, 'validate', 'accuracy/recall', n::DOUBLE FROM r "
    "UNION ALL SELECT model, seed, lr, weight_decay, epoch, NULL, 'seconds', n + 0.25::DOUBLE FROM r)")


@register("log_metrics", f"SELECT * FROM {_LOG_METRICS_SQL}")
def log_metrics(spark, sf):
    """The numbers of the logs: single values, cells of the class reports, seconds."""
    return runlog.log_metrics(_logs(spark, sf))


@register("log_leaderboard",
          f"WITH m AS {_LOG_METRICS_SQL}, e AS (SELECT model, seed, lr, weight_decay, epoch, "
          "max(CASE WHEN metric = 'macro_recall' THEN value END) AS metric, "
          "max(CASE WHEN metric = 'loss' THEN value END) AS loss, sum(CASE WHEN metric = 'seconds' THEN value END) AS sec "
          "FROM m GROUP BY ALL), "
          "b AS (SELECT *, row_number() OVER (PARTITION BY model, seed, lr, weight_decay ORDER BY metric DESC, epoch) AS nth, "
          "sum(sec) OVER (PARTITION BY model, seed, lr, weight_decay) AS elapsed, "
          "count(*) OVER (PARTITION BY model, seed, lr, weight_decay) AS epochs FROM e) "
          "SELECT row_number() OVER (ORDER BY metric DESC, model, seed) AS rank, model, seed, epoch AS best_epoch, "
          "metric AS val_macro_recall, loss AS train_loss, elapsed AS elapsed_sec, epochs FROM b WHERE nth = 1")
def log_leaderboard(spark, sf):
    """Every run by its best epoch, with the time it took: from the logs alone."""
    run = ["model", "seed", "lr", "weight_decay"]
    m = runlog.log_metrics(_logs(spark, sf))
    hist = m.groupBy(*run, "epoch").agg(F.max(F.when(F.col("metric") == "macro_recall", F.col("value"))).alias("metric"),
                                        F.max(F.when(F.col("metric") == "loss", F.col("value"))).alias("loss"),
                                        F.sum(F.when(F.col("metric") == "seconds", F.col("value"))).alias("sec"))
    hist = hist.withColumn("run_id", F.concat_ws("|", *run))
    took = hist.groupBy("run_id").agg(F.sum("sec").alias("elapsed_sec"), F.count(F.lit(1)).alias("epochs"))
    b = R.best_so_far(hist)
    s = R.summarize(b, R.early_stop(b, patience=MAX_EPOCHS).select("run_id", "stop_epoch"), ["metric", "loss", "model", "seed"])
    lb = R.leaderboard(s.join(took, "run_id"), "metric")
    return lb.select(F.col("rank").cast("long").alias("rank"), "model", "seed", "best_epoch",
                     F.col("metric").alias("val_macro_recall"), F.col("loss").alias("train_loss"), "elapsed_sec", "epochs")


def _recorded_sql():
    runs = " UNION ALL ".join(
        f"SELECT {seed} AS seed, {wd}::DOUBLE AS weight_decay, {epoch} AS epoch, split, metric, value "
        f"FROM {reply_metrics_sql(reply_head(seed, wd, epoch))}"
        for seed, wd in REPLY_RUNS for epoch in range(1, REPLY_EPOCHS + 1))
    return (f"WITH r AS ({runs}), v AS (SELECT * FROM r WHERE split = 'validate' AND metric = 'macro_recall'), "
            "best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY seed, weight_decay "
            "ORDER BY value DESC, epoch) = 1) "
            "SELECT row_number() OVER (ORDER BY best.value DESC, 'head-seed-' || best.seed || '-lr1e-05-wd' || best.weight_decay) AS rank, "
            "best.seed::BIGINT AS seed, best.weight_decay, best.epoch::BIGINT AS best_epoch, round(best.value, 9) AS val_macro_recall, "
            "round(t.value, 9) AS test_macro_recall FROM best JOIN r t ON t.seed = best.seed "
            "AND t.weight_decay = best.weight_decay AND t.epoch = best.epoch AND t.split = 'test' AND t.metric = 'macro_recall'")


@register("recorded_leaderboard", _recorded_sql())
def recorded_leaderboard(spark, sf):
    """Score -> epoch record -> append to the metrics table -> best epoch by validation
    macro recall -> test metric there, for runs that differ in seed and weight decay."""
    path = scratch_path(spark, "records")
    runs = [(seed, wd, epoch) for seed, wd in REPLY_RUNS for epoch in range(1, REPLY_EPOCHS + 1)]
    names = spark.createDataFrame(
        [(i, f"head-seed-{seed}-lr1e-05-wd{wd}", seed, wd, epoch) for i, (seed, wd, epoch) in enumerate(runs)],
        "head int, run_id string, seed long, weight_decay double, epoch long")
    m = reply_records(spark, sf, [reply_head(*run) for run in runs])
    runlog.append_metrics(m.join(broadcast_if_bounded(names, len(runs)), "head").drop("head"), path)
    m = runlog.read_metrics(spark, path).filter(F.col("metric") == "macro_recall")
    run = ["run_id", "seed", "weight_decay", "epoch"]
    hist = m.groupBy(*run).agg(F.max(F.when(F.col("split") == "validate", F.col("value"))).alias("metric"),
                               F.max(F.when(F.col("split") == "test", F.col("value"))).alias("test"))
    b = R.best_so_far(hist)
    s = R.summarize(b, R.early_stop(b).select("run_id", "stop_epoch"), ["metric", "test", "seed", "weight_decay"])
    lb = R.leaderboard(s, "metric")
    return lb.select(F.col("rank").cast("long").alias("rank"), "seed", "weight_decay", "best_epoch",
                     F.round("metric", 9).alias("val_macro_recall"), F.round("test", 9).alias("test_macro_recall"))


@register("metrics_append",
          "SELECT run_id, epoch, split, metric, value FROM ("
          f"SELECT run_id, epoch, 'validate' AS split, 'purchase_rate' AS metric, round(metric, 9) AS value FROM {HISTORY_SQL} "
          f"UNION ALL SELECT run_id, epoch, 'test', 'click_rate', round(test_metric, 9) FROM {HISTORY_SQL})")
def metrics_append(spark, sf):
    """Append validation then test metrics to the metrics table; read back."""
    h = history(spark, sf)
    path = scratch_path(spark, "metrics")
    for split, name, col in (("validate", "purchase_rate", "metric"), ("test", "click_rate", "test_metric")):
        runlog.append_metrics(h.select("run_id", "epoch", F.lit(split).alias("split"),
                                       F.lit(name).alias("metric"), F.round(col, 9).alias("value")), path)
    m = runlog.read_metrics(spark, path)
    return m.select(F.col("run_id").cast("long").alias("run_id"), "epoch", "split", "metric", "value")


@register("metrics_append_retry",
          "SELECT run_id, epoch, 'validate' AS split, 'purchase_rate' AS metric, round(metric, 9) AS value "
          f"FROM {HISTORY_SQL}")
def metrics_append_retry(spark, sf):
    """The same append run twice, its first try with a wrong value, and a third that fails half-way: read back once."""
    h = history(spark, sf)
    path = scratch_path(spark, "metrics")
    rows = h.select("run_id", "epoch", F.lit("validate").alias("split"), F.lit("purchase_rate").alias("metric"),
                    F.round("metric", 9).alias("value"))
    runlog.append_metrics(rows.withColumn("value", F.col("value") + 1), path)
    runlog.append_metrics(rows, path)
    runlog.stage_metrics(rows.withColumn("value", F.col("value") + 2), path)
    return runlog.read_metrics(spark, path).select(
        F.col("run_id").cast("long").alias("run_id"), "epoch", "split", "metric", "value")


def _grid_sql():
    runs = " UNION ALL ".join(
        f"SELECT '{model}' AS model, {seed}::BIGINT AS seed, {lr}::DOUBLE AS lr, {wd}::DOUBLE AS weight_decay, "
        f"{epoch}::BIGINT AS epoch, split, metric, value FROM {reply_metrics_sql(grid_head(model, seed, lr, wd, epoch))}"
        for model, seed, lr, wd in GRID_RUNS for epoch in range(1, REPLY_EPOCHS + 1))
    run = "model, seed, lr, weight_decay"
    return (f"WITH r AS ({runs}), v AS (SELECT * FROM r WHERE split = 'validate' AND metric = 'macro_recall'), "
            f"best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY {run} ORDER BY value DESC, epoch) = 1) "
            f"SELECT row_number() OVER (ORDER BY round(best.value, 9) DESC, {run}) AS rank, {run}, best.epoch AS best_epoch, "
            "round(best.value, 9) AS val_macro_recall, round(t.value, 9) AS test_macro_recall, round(l.value, 9) AS test_loss "
            f"FROM best JOIN r t USING ({run}, epoch) JOIN r l USING ({run}, epoch) WHERE t.split = 'test' "
            "AND t.metric = 'macro_recall' AND l.split = 'test' AND l.metric = 'loss'")


@register("run_grid_leaderboard", _grid_sql())
def run_grid_leaderboard(spark, sf):
    """Runs that differ in model, seed, rate and weight decay: all their epochs scored and recorded in one job, then ranked."""
    path = scratch_path(spark, "grid")
    runs = [(*run, epoch) for run in GRID_RUNS for epoch in range(1, REPLY_EPOCHS + 1)]
    names = spark.createDataFrame([(i, *run) for i, run in enumerate(runs)],
                                  "head int, model string, seed long, lr double, weight_decay double, epoch long")
    names = names.withColumn("run_id", F.concat_ws("|", "model", F.lpad(F.col("seed").cast("string"), 9, "0"),
                                                   F.format_string("%.9f", "lr"), F.format_string("%.9f", "weight_decay")))
    m = reply_records(spark, sf, [grid_head(*run) for run in runs])
    runlog.append_metrics(m.join(broadcast_if_bounded(names, len(runs)), "head").drop("head"), path)
    m = runlog.read_metrics(spark, path)
    run = ["model", "seed", "lr", "weight_decay"]

    def of(split, metric, name):
        return F.max(F.when((F.col("split") == split) & (F.col("metric") == metric), F.round("value", 9))).alias(name)

    hist = m.groupBy("run_id", *run, "epoch").agg(of("validate", "macro_recall", "metric"),
                                                  of("test", "macro_recall", "test"), of("test", "loss", "loss"))
    b = R.best_so_far(hist)
    s = R.summarize(b, R.early_stop(b).select("run_id", "stop_epoch"), ["metric", "test", "loss", *run])
    lb = R.leaderboard(s, "metric")
    return lb.select(F.col("rank").cast("long").alias("rank"), *run, "best_epoch",
                     F.col("metric").alias("val_macro_recall"), F.col("test").alias("test_macro_recall"),
                     F.col("loss").alias("test_loss"))
