import pytest
from conftest import SF01
from pyspark.sql import functions as F

from threadlens.llm import mixing, queries

NATIVE = ("Python", "Pandas", "Arrow")


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by sharing out again what capped sources cannot take."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            target |= {s: budget * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
        budget -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 100, "c": 100}, {"b": 7, None: 50, "": 3, "ä": 900, "z": 40},
                                   {"a": 0, "b": 5}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.allocate(rows).collect()}
    assert got == pytest.approx(water(sizes))


def test_every_source_comes_within_half_a_document(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"),
                                    (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("size"))
    got = mixing.mix(rows)
    assert got.count() == 5000 and got.filter("copies not between 0 and 2").count() == 0
    for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("t"),
                                       F.max("size").alias("most")).collect():
        assert abs(r.taken - r.t) <= r.most / 2 + 1
    again = mixing.mix(rows.repartition(3))
    assert got.select("id", "copies").exceptAll(again.select("id", "copies")).count() == 0


def test_marginals_keep_their_mean(spark):
    """Over many sources of equal make each document's copies average target / size."""
    rows = spark.range(300 * 20).select("id", F.lpad((F.col("id") / 20).cast("int").cast("string"), 4, "0").alias("source"),
                                        (F.col("id") % 20 + 1).alias("size"))
    mean = mixing.mix(rows).groupBy("size").agg(F.avg(F.col("copies") - F.col("target") / F.col("source_size")).alias("d"))
    assert max(abs(r.d) for r in mean.collect()) < 0.12


def test_whole_table_and_plan(spark):
    got = queries.op6_mixing(spark, SF01)
    assert not any(n in got._jdf.queryExecution().toString() for n in NATIVE)
    rows = got.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = water(sizes)
    assert len(rows) == 1000
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken in (0, r["size"], 2 * r["size"])


def test_hard_rows(hard, clashing, empty):
    rows = hard.select(F.col("doc_id").alias("id"), "source", mixing.size_of().alias("size"))
    got = mixing.mix(rows).collect()
    assert len(got) == hard.count()
    assert {r.source for r in got} == {"a", "b", "c", None}
    assert mixing.mix(rows.limit(0)).count() == 0
    mixed = mixing.remix(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.remix(empty).count() == 0
