"""Hard negatives by exact inner products in a residue number system.

Vectors hold integers. Their components are reduced modulo several small primes, and
for each prime the product of two matrices of residues is one float32 matrix product:
residues are signed (at most half a prime), and the inner dimension is cut into runs of
``RUN``, so every partial sum stays below 2^24, where float32 is exact. Scores are put
together from their residues by Chinese remaindering in mixed radix; as many primes are
taken as the largest possible score of the table needs, so signs and values are exact.

All rows are dealt into blocks of about ``ROWS``. Every block meets all anchors, which
are streamed past it in short batches, twice: first for each anchor's best rows of its
own label (only rows of that label are multiplied), then, the positives being known, for
the best rows of other labels within the window of scores that each positive opens.
A block sends on at most ``k`` rows an anchor and window, and windows over these give the result.

Defined results: rows with a null id, label or vector take no part; shorter vectors
count as padded with zeros; an anchor id that repeats asks once (with its least vector,
then label), and no row with the anchor's id is its positive or negative; other repeated
rows count as often as they occur. Equal scores go to the smaller id. Scores are limited
to the range of a long, after all comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

ROWS = 16384
ANCHORS = 128
RUN = 64
_LONG = (1 << 63) - 1


def primes(bound: int) -> list[int]:
    """Primes whose product exceeds 2 * bound, falling from the largest that keeps float32 sums exact."""
    out, product = [], 1
    p = 2 * int((((1 << 24) - 1024) // RUN) ** 0.5)
    while product <= 2 * bound + 1:
        p -= 1
        if p < 3:
            raise ValueError("scores are too large for the primes that float32 allows")
        if all(p % d for d in range(2, int(p ** 0.5) + 1)):
            out.append(p)
            product *= p
    return out


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """Signed residues of whole numbers, a float32 matrix a prime."""
    out = []
    for p in moduli:
        r = x % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, signed, for matrices of signed residues."""
    total = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, a.shape[1], RUN):
        part = a[:, lo:lo + RUN] @ b[:, lo:lo + RUN].T  # whole numbers below 2^24
        total += part - p * np.rint(part / p)
        total -= p * np.rint(total / p)
    return total


def scores(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact inner products from the residues of both sides, limited to the range of a long."""
    whole = 1
    for p in moduli:
        whole *= p
    kind = np.int64 if whole < 1 << 62 else object
    value, radix = None, 1
    for n, p in enumerate(moduli):
        r = product_mod(a[n], b[n], p).astype(np.int64).astype(kind)
        if value is None:
            value = r % p
        else:  # the next mixed-radix digit
            value = value + radix * ((r - value) * pow(radix, -1, p) % p) if kind is object else \
                value + radix * (((r - value) % p) * pow(radix, -1, p) % p)
        radix *= p
    value = np.where(value > whole // 2, value - whole, value)
    return np.clip(value, -_LONG - 1, _LONG).astype(np.int64) if kind is object else value


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list array as integers, padded with zeros to ``dim``."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), dim), np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id, in that order."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    order = sorted(at.tolist(), key=lambda i: (-int(score[i]), int(ids[i])))
    return np.array(order[:k], np.int64)


class Block:
    """Rows of one block, by label, with their residues."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, moduli: list[int]) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.moduli = ids[order], labels[order], moduli
        self.parts = residues(vectors[order], moduli)

    def positives(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple]:
        """(anchor, row, score) of the best rows of each anchor's label."""
        out = []
        for label in np.unique(labels).tolist():
            mine = np.flatnonzero(labels == label)
            lo, hi = np.searchsorted(self.labels, [label, label + 1])
            if lo == hi:
                continue
            found = scores(residues(vectors[mine], self.moduli), [r[lo:hi] for r in self.parts], self.moduli)
            for i, row in zip(mine.tolist(), found):
                other = np.flatnonzero(self.ids[lo:hi] != ids[i])
                for j in best(row[other], self.ids[lo:hi][other], k).tolist():
                    out.append((int(ids[i]), int(self.ids[lo:hi][other[j]]), int(row[other[j]])))
        return out

    def negatives(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: list[list], k: int,
                  low: int, high: int) -> list[tuple]:
        """(anchor, window, row, score) of the best rows of other labels in each anchor's windows (nth, score)."""
        out = []
        found = scores(residues(vectors, self.moduli), self.parts, self.moduli)
        for i, row in enumerate(found):
            large = max(int(row.max()), -int(row.min())) > _LONG // high
            wide = row.astype(object) if large else row
            other = (self.labels != labels[i]) & (self.ids != ids[i])
            for nth, score in windows[i]:
                inside = np.flatnonzero(other & (wide <= score) & (high * wide >= low * score))
                for j in best(row[inside], self.ids[inside], k).tolist():
                    out.append((int(ids[i]), nth, int(self.ids[inside[j]]), int(row[inside[j]])))
        return out


def _meet(dim: int, moduli: list[int], answer, names: list[str]):
    """A mapInArrow function over rows by (block, side): holds a block's rows, streams its anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, block = [], None, None
        for batch in batches:
            numbers, sides = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "side"))
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(sides) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                if lo == hi:
                    continue
                if numbers[lo] != current:
                    held, current, block = [], numbers[lo], None
                part = batch.slice(lo, hi - lo)
                columns = (part["vec_id"].to_numpy(), part["label"].to_numpy(), _matrix(part["v"], dim))
                if sides[lo] == 0:
                    held.append(columns)
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(*[np.concatenate(c) for c in zip(*held)], moduli), []
                for at in range(0, hi - lo, ANCHORS):
                    rows = answer(block, *[c[at:at + ANCHORS] for c in columns], part.slice(at, ANCHORS))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)
    return run


def mine(rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, low: int = 80,
         high: int = 100, block: int = ROWS) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by ``every``.

    ``rows`` has vec_id, label and v, an array of longs. For an anchor and one of its ``n_positives``
    best rows of the same label, the best rows of other labels with
    ``low * positive_score <= high * negative_score <= high * positive_score``:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = save(rows.select("vec_id", F.col("label").cast("long").alias("label"), "v")
                .filter("vec_id is not null and label is not null and v is not null"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"),
                    F.max(F.array_max("v")).alias("hi"), F.min(F.array_min("v")).alias("lo")).first()
    dim = size.dim or 1
    moduli = primes(dim * max(abs(size.hi or 0), abs(size.lo or 0)) ** 2)
    n_blocks = max(1, -(-size.n // block))
    # read from the checkpoint's files, a row keeps its number; so rows that repeat an id spread out, too
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
                        .alias("block"), F.lit(0).alias("side"), "vec_id", "label", "v")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id") \
        .agg(F.min(F.struct("v", "label")).alias("q")).select("vec_id", "q.label", "q.v")

    def met(anchors: DataFrame, answer, names: list[str]) -> DataFrame:
        to_all = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))),
                                      "side": F.lit(1)})
        both = dealt.unionByName(to_all, allowMissingColumns=True) \
            .repartition("block").sortWithinPartitions("block", "side")
        return both.mapInArrow(_meet(dim, moduli, answer, names), ", ".join(f"{n} long" for n in names))

    def same_label(rows_of: Block, ids, labels, vectors, _) -> list[tuple]:
        return rows_of.positives(ids, labels, vectors, n_positives)

    def in_windows(rows_of: Block, ids, labels, vectors, batch) -> list[tuple]:
        windows = [[(w["nth"], w["positive_score"]) for w in ws] for ws in batch["positives"].to_pylist()]
        return rows_of.negatives(ids, labels, vectors, windows, n_negatives, low, high)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = save(met(asked, same_label, ["anchor_id", "positive_id", "positive_score"])
                     .withColumn("nth", F.row_number().over(first).cast("long"))
                     .filter(F.col("nth") <= n_positives))
    windows = positives.groupBy("anchor_id").agg(  # at most n_positives an anchor
        F.collect_list(F.struct("nth", "positive_score")).alias("positives"))
    found = met(asked.join(windows, asked["vec_id"] == windows["anchor_id"]).drop("anchor_id"), in_windows,
                ["anchor_id", "nth", "negative_id", "negative_score"])
    order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives) \
        .join(positives, ["anchor_id", "nth"]) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
