"""Run selection on the fixture histories."""

import math

from threadlens.operators import runs as R

HIST = [0.1, 0.5, 0.4, 0.5, 0.45, 0.2, 0.9]


def _hist(spark, metrics, run=1):
    return spark.createDataFrame([(run, i + 1, m) for i, m in enumerate(metrics)],
                                 "run_id long, epoch int, metric double")


def test_best_epoch_and_stop(spark):
    b = R.best_so_far(_hist(spark, HIST))
    best = [r.best_epoch for r in b.orderBy("epoch").collect()]
    assert best == [1, 2, 2, 2, 2, 2, 7]           # the tie at epoch 4 keeps epoch 2
    s = R.early_stop(b, patience=3).first()
    assert s.stop_epoch == 5                       # 5 - 2 >= 3
    summ = R.summarize(b, R.early_stop(b, patience=3), ["metric"]).first()
    assert summ.best_epoch == 2 and summ.metric == 0.5   # epoch 7 comes after the stop


def test_nan_never_improves(spark):
    b = R.best_so_far(_hist(spark, [0.3, math.nan, 0.2, 0.4]))
    assert [r.best_epoch for r in b.orderBy("epoch").collect()] == [1, 1, 1, 4]


def test_all_equal(spark):
    b = R.best_so_far(_hist(spark, [0.5, 0.5, 0.5, 0.5]))
    assert [r.improved for r in b.orderBy("epoch").collect()] == [True, False, False, False]
    assert R.early_stop(b, patience=3).first().stop_epoch == 4


def test_hot_run_spans_blocks(spark):
    # one run with more epochs than a bucket block: offsets must carry across
    from pyspark.sql import functions as F
    from threadlens.operators.ordered import block_bucket, running
    n = 10000
    df = spark.range(1, n + 1).select(F.lit(1).alias("run_id"), F.col("id").alias("epoch"),
                                      ((F.col("id") * 7919) % 1000).alias("v"))
    r = running(df, ["run_id"], ["epoch"], {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))},
                bucket=block_bucket("epoch", 512))
    got = {x.epoch: (x.m, x.s) for x in r.collect()}
    m = s = 0
    for e in range(1, n + 1):
        v = (e * 7919) % 1000
        m, s = max(m, v), s + v
        assert got[e] == (m, s)


def test_numbers_of_a_log(spark, tmp_path):
    from threadlens.sources import runlog
    report = ("Best test clf_report:\n               precision    recall  f1-score   support\n\n"
              "     no help       0.50      1.00      0.67         3\n    accuracy                           0.60         5\n"
              "weighted avg       0.70      0.60      0.57         5\n")
    stamp = "2022-01-02 03:04:0{},000 - 7 - INFO - "
    records = ["Namespace(seed=3)", "Epoch: 1", "Train loss: 0.5", "Best val f1: nan?", report, "time: 12.5s\n", "done"]
    folder = tmp_path / "log=m-seed-3-lr1e-05-wd0.001.log"
    folder.mkdir()
    (folder / "part.txt").write_text("\n".join(stamp.format(i) + r for i, r in enumerate(records)))
    got = {(r.epoch, r.split, r.metric): r.value for r in runlog.log_metrics(runlog.read_logs(spark, str(tmp_path))).collect()}
    cells = {"no help/precision": .5, "no help/recall": 1, "no help/f1-score": .67, "no help/support": 3,
             "accuracy/f1-score": .6, "accuracy/support": 5, "weighted avg/precision": .7, "weighted avg/recall": .6,
             "weighted avg/f1-score": .57, "weighted avg/support": 5}
    assert got == {(1, "train", "loss"): .5, (1, None, "seconds"): 12.5,
                   **{(1, "test", k): v for k, v in cells.items()}}
