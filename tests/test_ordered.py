"""Distributed running aggregates vs. brute force, with a hot group."""

from pyspark.sql import functions as F

from threadlens.operators.ordered import hash_bucket, positions, running
from threadlens.session import scratch_path
from threadlens.sources.tables import SCAN_PARTITIONS, deal


def test_positions_hot_group_and_ties(spark):
    # group "a" holds most rows; order key has many ties broken by id
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 8, "a").otherwise(F.when(F.col("id") % 2 == 0, "b").otherwise("c")).alias("g"),
        (F.col("id") % 37).alias("k"), F.col("id"))
    got = {(r.g, r.id): r.pos for r in positions(df, ["g"], ["k", "id"], buckets=8).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.g, r.k, r.id))
    last, n = None, 0
    for r in rows:
        n = n + 1 if r.g == last else 1
        last = r.g
        assert got[(r.g, r.id)] == n


def test_running_sum_excluding_current(spark):
    df = spark.range(1, 501).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.k: r.s for r in running(df, [], ["k"], {"s": ("sum", F.col("v"))},
                                     inclusive=False, buckets=5).collect()}
    acc = 0
    for k in range(1, 501):
        assert got[k] == acc
        acc += k % 7


def test_hash_bucket_follows_the_key(spark):
    df = spark.range(0, 2000).select(F.md5(F.col("id").cast("string")).alias("k"))
    rows = sorted((r.k, r.b) for r in df.select("k", hash_bucket("k", 2).alias("b")).collect())
    assert all(x[1] <= y[1] for x, y in zip(rows, rows[1:]))
    assert len({b for _, b in rows}) > 200


def test_many_buckets_compile(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("k"))
    got = positions(df, [], ["k"], buckets=10_000).collect()
    assert sorted(r.pos for r in got) == list(range(1, 501)) and all(r.pos == r.k + 1 for r in got)


def test_scans_are_dealt_only_on_demand(spark):
    path = scratch_path(spark, "one-file")
    spark.range(0, 100).select(F.col("id").alias("doc_id")).coalesce(1).write.parquet(path)
    before = spark.conf.get(SCAN_PARTITIONS, None)
    try:
        spark.conf.unset(SCAN_PARTITIONS)
        df = spark.read.parquet(path)
        assert deal(df, ("doc_id",)) is df
        spark.conf.set(SCAN_PARTITIONS, "8")
        assert deal(df, ("doc_id",)).rdd.getNumPartitions() == 8
    finally:
        spark.conf.set(SCAN_PARTITIONS, before) if before else spark.conf.unset(SCAN_PARTITIONS)
