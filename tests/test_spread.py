"""Work on texts is dealt out however a table is laid out, and is done once."""

import pytest
from pyspark.sql import functions as F

from threadlens.functions import patterns as P
from threadlens.operators import encode as EN
from threadlens.plans import QUERIES, q_io, q_score

TEXTS = ["The man's ten 3rd-rate dogs. See http://a.b/c!", "", None, "und der Ärger — the end", "thr* one, many 12"]


@pytest.fixture
def tables(spark, tmp_path):
    """One file and one row group a table; ids repeat and are null; scans as Spark makes them."""
    docs = [(i, TEXTS[i % 5] and f"{TEXTS[i % 5]} w{i % 7} the") for i in range(60)] + [(3, "again one the"), (None, "no id")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long") \
        .coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 60, 2)], "doc_id long, quality long") \
        .coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    old = spark.conf.get("threadlens.scanPartitions", None)
    spark.conf.unset("threadlens.scanPartitions")
    yield str(tmp_path)
    if old is not None:
        spark.conf.set("threadlens.scanPartitions", old)


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_features_of_one_row_group_are_computed_in_several_tasks(spark, tables):
    assert spark.read.parquet(f"{tables}/documents.parquet").rdd.getNumPartitions() == 1
    assert tasks(q_score.featurized(spark, tables)) > 1
    assert tasks(q_io.classifier_rows(spark, tables)) > 1


def test_only_labelled_documents_are_hashed_and_all_are_counted(spark, tables):
    lab = spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("label"))
    got = q_score.featurized(spark, tables, lab)
    want = q_score.featurized(spark, tables).join(lab, "doc_id", "left")
    want = want.withColumn("x", F.when(F.col("label").isNotNull(), F.col("x"))).select(got.columns)
    key = lambda r: tuple(map(str, r))
    assert got.count() == 62 and sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


@pytest.mark.parametrize("name", ["labelled_samples", "unlabelled_samples", "encode_padded_mask"])
def test_texts_are_cleaned_once(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "http[^" not in plan


def test_unlabelled_samples_of_repeated_and_null_ids(spark, tables):
    rows = QUERIES["unlabelled_samples"](spark, tables).collect()
    # the two texts of id 3 are paired by id; a text without an id has no sample
    assert sorted(r.doc_id for r in rows) == sorted([3, 3, 3] + list(range(1, 60, 2)))


def test_padding_reads_computed_sequences(spark):
    docs = spark.range(40).select("id", (F.col("id") % 2).alias("split"), F.expr("repeat('a b ', int(id))").alias("t"))
    e = EN.encode(docs, ["id"], "t", EN.fit_vocabulary(docs, "t"), 16, carry=("split",))
    p = EN.pad(e, ["split"], 2)
    assert "regexp_extract_all" not in p._jdf.queryExecution().executedPlan().toString()
    assert {r.n for r in p.select(F.size("input_ids").alias("n")).collect()} == {16}


def test_word_pattern_reads_every_character_as_the_plain_one(spark):
    every = spark.range(0x110000).filter("id < 55296 or id > 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    pairs = every.select(F.concat(F.lit("a"), "c", F.lit("-"), "c", F.lit("b'1 "), "c").alias("t"))
    found = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (P.WORD_TOKEN, P.WORD_TOKEN_SPARK)]
    assert pairs.filter(found[0] != found[1]).count() == 0
