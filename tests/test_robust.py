"""Hostile texts, files as the task's own tools write them, runs without a best epoch."""

import time

import pytest
from pyspark.sql import functions as F

from threadlens.functions import clean, stat_columns
from threadlens.operators import evaluate as E
from threadlens.operators import runs as R
from threadlens.operators.encode import load_vocabulary, save_vocabulary, vocabulary
from threadlens.operators.hashing import hashed_tf
from threadlens.operators.lexicon import lexicon_counts, lexicon_from_pairs, load_lexicon, save_lexicon
from threadlens.session import scratch_path, shared_dir
from threadlens.sources import runlog
from threadlens.sources.lexicon_file import read_dic
from threadlens.sources.splits import CSV_OPTIONS, read_flat_splits


@pytest.mark.parametrize("text,words,emoji", [
    ("a" + "-a" * 100_000, 1, 0),
    ("\U0001F468" + "‍\U0001F469" * 100_000, 200_001, 1),
    ("a" + " " * 1_000_000 + "b", 2, 0),
    (" " * 500_000 + "a" + " " * 500_000, 1, 0),
    ("." * 100_000 + "x", 100_001, 0),
    ("!" * 100_001, 100_001, 0),
])
def test_long_runs_take_seconds(spark, tmp_path, text, words, emoji):
    spark.createDataFrame([(1, text)], "id long, text string").write.parquet(str(tmp_path / "t"))
    t0 = time.time()
    df = spark.read.parquet(str(tmp_path / "t")).select("id", clean("text").alias("c"), "text")
    row = df.select("c", *stat_columns("text")).first()
    assert (row.n_words, row.n_emoji) == (words, emoji) and time.time() - t0 < 20
    if "b" in text:
        assert row.c == "a b"
    if text.startswith(" "):
        assert row.c == "a"


def write_csv(spark, base, name, header, rows):
    spark.createDataFrame(rows, ", ".join(f"{h} string" for h in header)).coalesce(1) \
        .write.options(**CSV_OPTIONS).csv(f"{base}/{name}.csv")


def test_flat_files_by_header_name(spark):
    base = scratch_path(spark, "flat-test")
    write_csv(spark, base, "train", ["label", "reply_cleaned", "x"], [("1", "a\nb", "q"), ("2.0", "nan", "q")])
    write_csv(spark, base, "validate", ["reply_cleaned", "label"], [("c", "0"), (None, None)])
    got = read_flat_splits(spark, base, "reply_cleaned string, label int", ("reply_cleaned",), ("train", "validate"))
    assert {tuple(r) for r in got.collect()} == {("a\nb", 1, "train"), (None, 2, "train"), ("c", 0, "validate"),
                                                 (None, None, "validate")}
    with pytest.raises(ValueError, match="no column"):
        read_flat_splits(spark, base, "content_cleaned string, label int", (), ("train",))
    write_csv(spark, base, "test", ["reply_cleaned", "label"], [("c", "one")])
    with pytest.raises(Exception, match="holds no number"):
        read_flat_splits(spark, base, "reply_cleaned string, label int", (), ("test",)).collect()


LOG = """2024-01-01 10:00:00,001 - 77 - INFO - Namespace(seed=3, lr=1e-05)
2024-01-01 10:00:01,000 - 77 - INFO - Epoch: 1
2024-01-01 10:00:01,002 - 77 - INFO - Train loss: 0.5
2024-01-01 10:00:01,003 - 77 - INFO - Best val clf_report:
               precision    recall

           1       0.50      0.25
2024-01-01 10:00:01,009 - 77 - INFO - time: 12.3456s

2024-01-01 10:00:02,000 - 77 - WARNING - something odd
2024-01-01 10:00:03,000 - 77 - INFO - Epoch: 2
2024-01-01 10:00:03,500 - 77 - INFO - Train loss: 0.25
"""


def test_log_records_keep_their_lines_and_epochs(spark, tmp_path):
    (tmp_path / "roberta-base-seed-3-lr1e-05-wd0.001.log").write_text(LOG)
    rows = runlog.read_logs(spark, str(tmp_path)).orderBy("nth").collect()
    assert {(r.model, r.seed, r.lr, r.weight_decay, r.process) for r in rows} == {("roberta-base", 3, "1e-05", 0.001, 77)}
    assert [(r.epoch, r.key) for r in rows] == [
        (None, "arguments"), (1, "Epoch"), (1, "Train loss"), (1, "Best val clf_report"), (1, "time"), (1, None),
        (2, "Epoch"), (2, "Train loss")]
    assert rows[3].value_text.split("\n")[0].strip() == "precision    recall" and "0.25" in rows[3].value_text
    assert rows[4].value_text == "12.3456s" and rows[5].value_text == "something odd"
    assert rows[7].logged_at.microsecond == 500_000


def test_runs_that_never_improve_stay(spark):
    nan = float("nan")
    hist = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, nan), (2, 2, None), (3, 1, -2.0)],
                                 "run_id long, epoch long, metric double")
    best = R.best_so_far(hist)
    s = R.summarize(best, R.early_stop(best, patience=1).select("run_id", "stop_epoch"), ["metric"])
    assert {r.run_id: r.best_epoch for r in s.collect()} == {1: 1, 2: None, 3: None}
    ranked = sorted((r["rank"], r.run_id) for r in R.leaderboard(s, "metric").collect())
    assert ranked == [(1, 1), (2, 2), (3, 3)]
    assert R.leaderboard(s, "metric", k=1).count() == 1


def test_class_report_takes_two_exchanges(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("p"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("split"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = E.class_report(df, "y", "p", by=("split",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") <= 2
    whole = {r.row: r for r in E.class_report(df, "y", "p").collect()}
    assert whole["accuracy"].support == 300 and whole["3"].support == 0


def test_hashed_terms(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "z " * 5000)], "id long, t string")
    got = {r.id: r.x for r in hashed_tf(df, "id", "t", 16).collect()}
    assert sorted(x for x in got[1] if x) == pytest.approx([1 / 3, 2 / 3]) or max(got[1]) == 1.0
    assert got[2] == got[3] == [0.0] * 16 and max(got[4]) == 1.0 and all(len(x) == 16 for x in got.values())


def test_saved_state_is_the_same(spark):
    base = scratch_path(spark, "state-test")
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "a thin cat")], "id long, t string")
    save_vocabulary(vocabulary(docs, "t"), f"{base}/v")
    assert [(r.token, r.id) for r in load_vocabulary(spark, f"{base}/v").orderBy("id").collect()] == \
        [("cat", 4), ("the", 5), ("a", 6), ("and", 7), ("dog", 8), ("thin", 9)]
    assert vocabulary(docs, "t", size=2).count() == 2
    lex = lexicon_from_pairs(spark, [("th*", "x"), ("cat", "y")])
    again = load_lexicon(spark, save_lexicon(lex, f"{base}/l"))
    want = sorted(map(tuple, lexicon_counts(docs, "id", "t", lex).collect()))
    assert sorted(map(tuple, lexicon_counts(docs, "id", "t", again).collect())) == want


def test_dictionary_with_a_bad_category_fails(spark):
    path = scratch_path(spark, "dic-test")
    spark.createDataFrame([(x,) for x in ("%", "1\tone", "%", "word\t1", "term\t1\tx")], "value string") \
        .coalesce(1).write.text(path)
    with pytest.raises(Exception, match="no number"):
        read_dic(spark, path)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
