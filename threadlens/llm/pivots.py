"""Exact top-k inner products by pivot-table elimination.

Vectors hold integers. Pivots are picked from a bounded sample, each the farthest
from those before it. Every vector keeps its distances to all pivots (the pivot
table) and belongs to the cell of its nearest one; cells are dealt into blocks of
about ``BLOCK`` rows by a hash, so copies of one vector spread out too.

For a query q and a candidate c the largest |d(q,p) - d(c,p)| over the pivots p is
a lower bound of d(q,c), so (|q|^2 + |c|^2 - bound^2) / 2 is an upper bound of their
inner product. A block's candidates are evaluated in falling order of that
bound, until it drops below the query's k-th best score so far: what is left
cannot enter, and the result is exact.

Queries search their own block first. The k-th score found there already rules
out whole cells, by the ranges of the cells' pivot distances; queries visit the
blocks of the other cells only, in groups of at most about ``QUERIES``, against
one block at a time. The best of all visits are the result.

Inner products are exact: in floating point while they stay below 2^53, beyond
that in whole numbers, limited to the range of a long.

Defined results: rows with a null id, a null vector, or a null or non-finite
component take no part; shorter vectors count as padded with zeros; a query id
that repeats asks once (with its least vector), and no row with the query's id
is its candidate; repeated candidates are listed as often as they occur. Equal
scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

PIVOTS = 24
SAMPLE = 2000
BLOCK = 4096
QUERIES = 2048
_STEP = 64


def whole(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of each component, null if one is null or not finite."""
    inf = float("inf")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))
    return F.when(sound, F.transform(vector, lambda x: F.floor(factor * x.cast("double")).cast("long")))


def pick_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    away = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list array as integers, padded with zeros to ``dim``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), dim), np.int64)
    if len(vectors):
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(vectors)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to the pivots."""
    x = x.astype(float)
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _products(c: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (c.astype(float) @ q.astype(float)).astype(np.int64)
    full = [min(max(sum(map(int.__mul__, row, q.tolist())), -(1 << 63)), (1 << 63) - 1) for row in c.tolist()]
    return np.array(full, np.int64)


def search(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, c: np.ndarray, c_id: np.ndarray,
           pivots: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in one block, of those that reach its ``floor``."""
    if not len(c) or not len(q):
        return []
    dq, dc = _distances(q, pivots), _distances(c, pivots)
    nq, nc = (q.astype(float) ** 2).sum(axis=1), (c.astype(float) ** 2).sum(axis=1)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0 ** 53
    out = []
    for i in range(len(q)):
        bound = np.abs(dc - dq[i]).max(axis=1)
        upper = (nq[i] + nc - bound ** 2) / 2
        upper += 1e-9 * (nq[i] + nc) + 1e-6  # above rounding
        live = np.flatnonzero((upper >= floor[i]) & (c_id != q_id[i]))
        live = live[np.argsort(-upper[live], kind="stable")]
        best_score, best_id, least, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), floor[i], 0
        while lo < len(live) and upper[live[lo]] >= least:
            part = live[lo:lo + _STEP * (1 + lo // _STEP)]  # longer steps the further it goes
            best_score = np.concatenate([best_score, _products(c[part], q[i], exact)])
            best_id = np.concatenate([best_id, c_id[part]])
            order = np.lexsort((best_id, -best_score.astype(float) if exact else ~best_score))[:k]
            best_score, best_id = best_score[order], best_id[order]
            if len(order) == k:
                least = max(least, float(best_score[-1]))
            lo += len(part)
        out += [(int(q_id[i]), int(b), int(s)) for b, s in zip(best_id, best_score)]
    return out


_FOUND = "query_id long, vec_id long, score long"


def _found(rows: list[tuple[int, int, int]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])


def for_visits(dealt: DataFrame, choices: DataFrame) -> DataFrame:
    """A copy of each row of ``dealt`` for every group of queries (``part``) that visits its cell, and no other."""
    groups = choices.select("cell", "part").distinct().groupBy("cell").agg(F.collect_list("part").alias("parts"))
    # one row a cell, so no more than there are pivots
    return dealt.join(F.broadcast(groups), "cell").withColumn("part", F.explode("parts")).drop("parts")


def top_k(vectors: DataFrame, every: int, k: int = 5, n_pivots: int = PIVOTS, sample: int = SAMPLE,
          block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and v, an array of longs.
    """
    rows = vectors.select("vec_id", "v").filter("vec_id is not null and v is not null")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()  # bounded by ``sample``
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    points = np.zeros((len(drawn), dim))
    for i, r in enumerate(drawn):
        points[i, :len(r.v)] = r.v
    pivots = pick_pivots(points, n_pivots)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch["v"], dim), pivots)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(d.argmin(axis=1).astype(np.int32)),
                 pa.array(list(d), pa.list_(pa.float64())),
                 pa.array((_matrix(batch["v"], dim).astype(float) ** 2).sum(axis=1))],
                ["vec_id", "v", "cell", "away", "norm2"])

    table = save(rows.mapInArrow(place, "vec_id long, v array<long>, cell int, away array<double>, norm2 double"))
    # one row a cell: how many rows, the ranges of their distances to each pivot, the greatest norm
    cells = table.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("norm2").alias("norm2"),
        *[f(F.col("away")[i]).alias(f"{name}{i}") for i in range(len(pivots))
          for name, f in (("lo", F.min), ("hi", F.max))]).collect()
    n_blocks = {r.cell: -(-r.n // block) for r in cells}
    near = np.array([[r[f"lo{i}"] for i in range(len(pivots))] for r in cells])
    far = np.array([[r[f"hi{i}"] for i in range(len(pivots))] for r in cells])
    norm2 = np.array([r.norm2 for r in cells])
    names = np.array([r.cell for r in cells])

    blocks = F.element_at(F.create_map(*[F.lit(x) for kv in n_blocks.items() for x in kv]), F.col("cell"))
    dealt = table.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", F.lit(3)), blocks).cast("int").alias("block"))
    asked = table.filter(F.col("vec_id") % every == 0).groupBy("vec_id") \
        .agg(F.min(F.struct("v", "cell")).alias("q")).select("vec_id", "q.v", "q.cell")
    asked = save(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), blocks).cast("int")))
    n_groups = max(1, -(-asked.count() // queries))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n_groups)).cast("int"))

    def visit(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        if "vec_id" not in q.column_names or "vec_id" not in c.column_names:  # one side has no such block
            return _found([])
        floor = q["floor"].to_numpy() if "floor" in q.column_names else np.full(len(q), -np.inf)
        return _found(search(_matrix(q["v"], dim), q["vec_id"].to_numpy(), floor, _matrix(c["v"], dim),
                             c["vec_id"].to_numpy(), pivots, k))

    own = asked.withColumn("part", F.lit(0)).groupBy("cell", "block", "part") \
        .cogroup(dealt.withColumn("part", F.lit(0)).groupBy("cell", "block", "part")).applyInArrow(visit, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = save(own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that may hold a score of the query's floor or more."""
        for batch in batches:
            q = _matrix(batch["v"], dim)
            d, n2 = _distances(q, pivots), (q.astype(float) ** 2).sum(axis=1)
            floor = batch["floor"].to_numpy(zero_copy_only=False)
            gap = np.maximum(near[None] - d[:, None], d[:, None] - far[None]).max(axis=2).clip(0)
            upper = (n2[:, None] + norm2[None] - gap ** 2) / 2 + 1e-9 * (n2[:, None] + norm2[None]) + 1e-6
            at, cell = np.nonzero(upper >= floor[:, None])
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(at)), batch["v"].take(pa.array(at)),
                 batch["floor"].take(pa.array(at)), batch["part"].take(pa.array(at)),
                 pa.array(names[cell].astype(np.int32))], ["vec_id", "v", "floor", "part", "cell"])

    floor = F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
    choices = asked.drop("cell", "block").join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left") \
        .select("vec_id", "v", floor.alias("floor"), "part") \
        .mapInArrow(choose, "vec_id long, v array<long>, floor double, part int, cell int")
    visits = choices.withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    # each block meets one group of queries at a time
    parts = for_visits(dealt, choices)
    found = visits.groupBy("cell", "block", "part").cogroup(parts.groupBy("cell", "block", "part")) \
        .applyInArrow(visit, _FOUND)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
