import numpy as np
import pytest

from threadlens.llm import residues

SCHEMA = "vec_id long, label int, v array<long>"


def brute(rows, every=100, k=5, low=80, high=100):
    rows = [r for r in rows if None not in r]
    asked = {}
    for i, label, v in rows:
        if i % every == 0:
            asked[i] = min(asked.get(i, (v, label)), (v, label))
    out = []
    for a, (q, label) in asked.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, c) for i, c, v in rows if i != a]
        best = sorted((s, i) for s, i, c in scored if c == label)[:k]
        for s, i in best:
            inside = sorted((t, j) for t, j, c in scored if c != label and low * -s <= high * -t <= high * -s)
            out += [(a, i, n, j, -s, -t) for n, (t, j) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in residues.mine(df, **more).collect())


@pytest.mark.parametrize("scale, dim", [(3, 5), (300, 64), (10 ** 6, 70), (2 ** 62, 3)])
def test_exact_scores(scale, dim):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-scale, scale, (7, dim)), rng.integers(-scale, scale, (11, dim))
    moduli = residues.primes(dim * scale ** 2)
    got = residues.scores(residues.residues(a, moduli), residues.residues(b, moduli), moduli)
    want = a.astype(object) @ b.astype(object).T
    assert (got == np.clip(want, -2 ** 63, 2 ** 63 - 1)).all()


def test_float32_sums_stay_exact():
    p = residues.primes(1)[0]
    assert residues.RUN * (p // 2) ** 2 < 1 << 24
    worst = np.full((1, 3 * residues.RUN), p // 2, np.float32)
    assert int(residues.product_mod(worst, -worst, p)[0, 0]) % p == -(p // 2) ** 2 * 3 * residues.RUN % p


@pytest.mark.parametrize("block", [7, 16384])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    # small numbers: many ties
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-3, 4, 6).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, every=20, block=block) == brute(rows, every=20)


def test_hard_rows(spark):
    rows = [(0, 1, [3, 1]), (0, 1, [4, 1]), (100, 1, [3, 1, 0]), (1, 1, [9]), (2, 2, [2, 2]), (2, 2, [2, 2]),
            (3, 2, []), (None, 1, [1, 1]), (5, None, [1, 1]), (6, 1, None), (-100, 2, [-3, -1]), (8, 3, [2 ** 40, 1])]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = [(i, c, None if v is None else v + [0] * (3 - len(v))) for i, c, v in rows]
    want = brute(wide)
    extra = df.selectExpr("*", "1 as block", "2 as side", "3 as nth", "4 as anchor_id", "5 as n")
    assert mined(extra) == want and want
    assert residues.mine(df.limit(0)).count() == 0
    top = 2 ** 63 - 1  # scores beyond a long are limited to it
    huge = [(0, 1, [top] * 2), (1, 1, [2 ** 62, 5]), (2, 2, [2 ** 62, 4]), (3, 2, [-2 ** 63, 1]), (4, 2, [1, 0])]
    assert mined(spark.createDataFrame(huge, SCHEMA)) == [(0, 1, 1, 2, top, top), (0, 1, 2, 4, top, top)]
