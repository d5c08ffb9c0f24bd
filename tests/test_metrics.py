"""Evaluation goldens (hand-computed) and properties."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import evaluate as E


@pytest.fixture(scope="module")
def multi(spark):
    # classes 0,1,2 observed; 3 predicted but never observed; 2 never predicted
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 3)]
    return spark.createDataFrame(rows, "label int, prediction int")


def test_micro_macro_union_of_classes(multi):
    r = E.micro_macro(multi, "label", "prediction").first()
    # per class (precision, recall): 0 (1/2, 1/2), 1 (2/3, 1), 2 (0, 0), 3 (0, 0)
    assert r.n_classes == 4
    assert r.micro_precision == pytest.approx(3 / 6)
    assert r.macro_precision == pytest.approx((0.5 + 2 / 3) / 4)
    assert r.macro_recall == pytest.approx((0.5 + 1.0) / 4)
    f1 = [0.5, 0.8, 0.0, 0.0]
    assert r.macro_f1 == pytest.approx(sum(f1) / 4)


def test_report_footer(multi):
    rep = {r.row: r for r in E.class_report(multi, "label", "prediction").collect()}
    assert rep["accuracy"].f1 == pytest.approx(0.5) and rep["accuracy"].support == 6
    assert rep["weighted avg"].recall == pytest.approx((2 * 0.5 + 2 * 1.0 + 2 * 0.0) / 6)
    assert rep["3"].support == 0


def test_binary_no_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "label int, prediction int")
    r = E.binary_prf(df, "label", "prediction").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_confusion_sums_to_rows(multi):
    assert E.confusion(multi, "label", "prediction").agg(F.sum("n")).first()[0] == 6


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8), (0, 0.35), (1, 0.9)],
                               "label int, score double")
    # pairs (pos, neg): 0.4 vs {0.1, 0.35} win, vs 0.4 tie; 0.8, 0.9 beat all three
    assert E.roc_auc(df, "label", "score").first().auc == pytest.approx((2.5 + 3 + 3) / 9)
    one = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, score double")
    assert E.roc_auc(one, "label", "score").first().auc is None


def test_auc_symmetry(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double")
    a = E.roc_auc(df, "label", "score").first().auc
    b = E.roc_auc(df.withColumn("score", -F.col("score")), "label", "score").first().auc
    assert a + b == pytest.approx(1.0)
    # brute force over all pairs
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert a == pytest.approx(u / (len(pos) * len(neg)))


def test_epoch_metrics_record(spark):
    rows = [("validate", 1, 1, 0.9, 0.2, 0), ("validate", 0, 1, 0.6, 1.0, 0),
            ("validate", 1, 0, 0.3, 2.0, 1), ("validate", 0, 0, 0.1, 0.4, 1),
            ("test", 1, 1, 0.8, 0.5, 0), ("test", 1, 1, 0.7, 0.5, 0)]
    df = spark.createDataFrame(rows, "split string, label int, prediction int, score double, "
                                     "loss double, batch_id long")
    got = {(r.split, r.metric): r.value for r in E.epoch_metrics(df, batch="batch_id").collect()}
    assert got[("validate", "precision")] == pytest.approx(0.5)
    assert got[("validate", "recall")] == pytest.approx(0.5)
    assert got[("validate", "f1")] == pytest.approx(0.5)
    assert got[("validate", "auc")] == pytest.approx(0.75)       # pos {.9,.3} vs neg {.6,.1}: 3 of 4 pairs
    assert got[("validate", "loss")] == pytest.approx((0.6 + 1.2) / 2)   # mean of batch means
    assert got[("test", "auc")] is None                          # one class only
    assert got[("test", "loss")] == pytest.approx(0.5)
