"""The lexicon vector and the content vector inside the row; metrics appends that are repeated or fail."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens.operators.hashing import hashed_array, hashed_tf
from threadlens.operators.lexicon import lexicon_array, lexicon_from_pairs, lexicon_vector
from threadlens.sources import runlog

TEXTS = ["", None, "The rest of it, then. THE ret-urn", "don't do_it x.y", "über die Straße ÜBER", "a" * 500, "th th1 1th th",
         "İstanbul ﬁne 𝒳 word", "it's ... of-of of", "re\nre\tre", "naïve café", "日本 日本語"]
PATTERNS = [("th*", "a"), ("the", "b"), ("re", "b"), ("ret*", "c"), ("of", "a"), ("of", "c"), ("don't", "a"), ("x.y", "a"),
            ("do_it", "c"), ("über", "b"), ("日本*", "c"), ("1*", "a"), ("naïve", "b"), ("𝒳", "a")]


def both(spark, pairs, texts):
    lex = lexicon_from_pairs(spark, pairs, ["a", "b", "c", "none"])
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    want = {r.id: r.lex_vec for r in lexicon_vector(df, "id", "t", lex).collect()}
    got = {r.id: r.v for r in df.select("id", lexicon_array("t", lex).alias("v")).collect()}
    return got, want


def test_lexicon_array_equals_the_joined_vector(spark):
    got, want = both(spark, PATTERNS, TEXTS)
    assert got == want and sum(map(sum, want.values())) > 15


@pytest.mark.parametrize("pairs", [[("*", "a"), ("of", "b")], [("zzz", "c")], [("a", "a"), ("ab", "a"), ("abc*", "a")]])
def test_odd_lexicons(spark, pairs):
    got, want = both(spark, pairs, TEXTS + ["a ab abc abcd b"])
    assert got == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.text("ab_é", min_size=1, max_size=3), st.booleans(), st.sampled_from("abc")),
                      min_size=1, max_size=8),
       texts=st.lists(st.text("aAbB_éÉ -.", max_size=25), min_size=1, max_size=6))
def test_any_lexicon(spark, pairs, texts):
    got, want = both(spark, [(k + "*" * w, c) for k, w, c in pairs], texts)
    assert got == want


def test_hashed_array_equals_the_grouped_one(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    want = {r.id: r.x for r in hashed_tf(df, "id", "t", 16).collect()}
    assert {r.id: r.x for r in df.select("id", hashed_array("t", 16).alias("x")).collect()} == want


def rows(spark, epoch, value, split="validate"):
    return spark.range(3).select((F.col("id") + 1).alias("run_id"), F.lit(epoch).cast("long").alias("epoch"),
                                 F.lit(split).alias("split"), F.lit("f1").alias("metric"),
                                 F.lit(float(value)).alias("value"))


def test_appends_are_read_once(spark, tmp_path):
    path = str(tmp_path / "metrics")
    runlog.append_metrics(rows(spark, 1, 0.1), path)
    runlog.append_metrics(rows(spark, 1, 0.1, "test"), path)     # another split of the same epoch
    runlog.append_metrics(rows(spark, 1, 0.2), path)             # a repeat replaces the first try
    runlog.append_metrics(rows(spark, 2, 0.3), path)
    runlog.stage_metrics(rows(spark, 2, 0.9), path)              # fails before its manifest
    runlog.stage_metrics(rows(spark, 3, 0.9), path)
    got = sorted((r.run_id, r.epoch, r.split, r.value) for r in runlog.read_metrics(spark, path).collect())
    assert got == sorted((run, epoch, split, value) for run in (1, 2, 3)
                         for epoch, split, value in ((1, "validate", 0.2), (1, "test", 0.1), (2, "validate", 0.3)))
