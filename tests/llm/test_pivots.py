import numpy as np
from pyspark.sql import functions as F

from threadlens.llm import pivots


def brute(rows, every, k):
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in sound:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", pivots.whole("e").alias("v"))
    got = sorted(tuple(r) for r in pivots.top_k(df, 50, **kw).collect())
    assert got == brute(rows, 50, kw.get("k", 5))


def test_random_and_copied_vectors(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(0, 0.3, 8).tolist()
    rows = [(i, one if i % 3 == 0 else rng.normal(0, 0.3, 8).tolist()) for i in range(700)]
    check(spark, rows)
    check(spark, rows, block=64, queries=4, n_pivots=5)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (50, [0.1]), (1, [0.5, nan]), (2, None), (None, [1.0, 1.0]),
            (3, [inf, 0.0]), (4, [None, 1.0]), (5, []), (6, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [1e12, -1e12])]
    check(spark, rows)
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_integers_beyond_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1e6, 4).tolist()) for i in range(120)]
    check(spark, rows)


def test_bounds_rule_candidates_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (10, 16)).astype(np.int64)
    c = np.concatenate([m + rng.integers(-3, 4, (100, 16)) for m in centres])
    seen = []
    products = pivots._products
    pivots._products = lambda part, q, exact: (seen.append(len(part)), products(part, q, exact))[1]
    try:
        pivots.search(c[:5], np.arange(5), np.full(5, -np.inf), c, np.arange(len(c)), pivots.pick_pivots(c.astype(float)), 5)
    finally:
        pivots._products = products
    assert sum(seen) < 0.5 * 5 * len(c)


def test_columns(spark):
    df = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("e"), F.lit(1).alias("cell"))
    got = pivots.top_k(df.withColumn("v", pivots.whole("e")), 50)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_only_visited_cells_are_copied_for_a_group_of_queries(spark):
    dealt = spark.createDataFrame([(i, i % 4, 0) for i in range(40)], "vec_id long, cell int, block int")
    choices = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 2, 1), (4, 5, 1), (4, 0, 2)], "vec_id long, part int, cell int")
    got = sorted((r.vec_id, r.part) for r in pivots.for_visits(dealt, choices).collect())
    parts = {0: [0], 1: [2, 5], 2: [0]}  # nobody visits cell 3
    assert got == sorted((i, p) for i in range(40) for p in parts.get(i % 4, []))
