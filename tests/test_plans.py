"""Plan shape: no nested-loop joins, no Python UDFs, no unbounded
single-partition exchange, and parquet scans that prune columns."""

import pytest

from conftest import SF001
from threadlens.plans import QUERIES

# positions over all rows: the single partition holds one row a range, with its count
BOUNDED_SINGLE = {"vocabulary", "encode_ids", "encode_padded_mask", "labelled_samples",
                  "unlabelled_samples", "run_leaderboard", "recorded_leaderboard"}
ACTION_QUERIES = {"csv_roundtrip", "params_roundtrip", "metrics_append", "metrics_from_log",
                  "lexicon_from_file", "stream_clean_stats", "stream_head_scores",
                  "fit_fused_classifier", "csv_flat_files", "saved_vocabulary_lexicon",
                  "csv_quoted_lines", "lexicon_file_order", "metrics_append_retry",
                  "stream_fusion_scores", "fit_certificate", "run_grid_leaderboard", "log_metrics", "log_leaderboard",
                  "learnt_sentences"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTION_QUERIES))
def test_plan_shape(spark, name):
    df = QUERIES[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
    if name not in BOUNDED_SINGLE:
        # a global aggregate gathers one partial row per partition: bounded
        for line in plan.splitlines():
            if "SinglePartition" in line:
                idx = plan.splitlines().index(line)
                below = "\n".join(plan.splitlines()[idx + 1: idx + 3])
                assert "HashAggregate" in below and "partial" in below, (name, line)


def test_lexicon_projection_has_no_exchange(spark):
    spark.conf.unset("threadlens.scanPartitions")
    try:
        plan = QUERIES["lexicon_projection"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("threadlens.scanPartitions", "8")
    assert "Exchange" not in plan and "Join" not in plan


def test_frequent_tokens_do_not_cross_the_vocabulary_join(spark):
    from pyspark.sql import functions as F
    from threadlens.operators import encode as EN

    docs = spark.range(200).select("id", F.concat(F.lit("the of and "), F.col("id").cast("string")).alias("t"))
    vocab = EN.fit_vocabulary(docs, "t")
    out = EN.encode(docs, ["id"], "t", vocab, head=3)
    plain = EN.encode(docs, ["id"], "t", vocab, head=0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = EN.encode(docs, ["id"], "t", vocab, head=3)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    by_token = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(token" in line]
    # what is shuffled by token is the vocabulary itself, or occurrences that the broadcast join left without an id
    for i in by_token:
        below = " ".join(lines[i + 1:i + 4])
        assert "isnull(_tid" in below or "Scan ExistingRDD" in below, below
    assert any("isnull(_tid" in " ".join(lines[i + 1:i + 4]) for i in by_token)
    assert sum("BroadcastHashJoin" in line for line in lines) == 2
