"""Running (prefix) aggregates without a single-partition window.

A window ``ORDER BY k`` with no ``PARTITION BY`` (or one whose partition key
is hot) runs in one task. Instead:

1. range-partition the rows on (group keys, order keys) into ``buckets``
   balanced ranges (sampled bounds, equal keys land together);
2. aggregate each (group, bucket): a table of O(groups + buckets) rows;
3. a window over that small table gives each bucket the total of the
   buckets before it (its offset);
4. a window inside each (group, bucket) adds the local running value.

The bucket id must be the same in both uses of the bucketed rows (totals
and the final window), and the same again if a lost task is recomputed.
Callers whose order key is dense (ids, epochs) or uniform (a hash) pass a
``bucket`` expression, a pure function of the row. Otherwise the rows are
range-partitioned once (Spark samples the bounds), tagged with their range and
materialized in the shared folder, and both uses read that.

Supported kinds are associative: ``sum``, ``count`` and ``max`` (``max``
also works on structs, e.g. ``struct(metric, -epoch)`` for "best so far,
earliest on ties"). Frames are row-based: ties in the order keys are
broken by the remaining keys given, so pass unique order keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .util import as_col

_AGG = {"sum": F.sum, "count": F.count, "max": F.max}


def _combine(kind: str, off: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(off, local)
    return F.coalesce(off, F.lit(0)) + F.coalesce(local, F.lit(0))


def running(df: DataFrame, partition_by: list[str], order_by: list[str],
            aggs: dict[str, tuple[str, Column | str]], inclusive: bool = True,
            buckets: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Add running aggregates ``aggs = {out: (kind, column)}`` to ``df``.

    ``inclusive`` frames end at the current row; otherwise at the row before.
    """
    for kind, _ in aggs.values():
        if kind not in _AGG:
            raise ValueError(f"unsupported running aggregate {kind!r}")
    keys = [*partition_by, *order_by]
    vals = {f"_v_{o}": as_col(c) for o, (_, c) in aggs.items()}
    rows = df.withColumns(vals)
    if bucket is not None:
        ranged = rows.withColumn("_b", bucket)
    else:
        by = rows.repartitionByRange(buckets, *keys) if buckets else rows.repartitionByRange(*keys)
        ranged = materialize(by.withColumn("_b", F.spark_partition_id()))

    # (2) per-bucket totals and (3) offsets of the buckets before each one.
    per = ranged.groupBy(*partition_by, "_b").agg(
        *[_AGG[k](f"_v_{o}").alias(f"_t_{o}") for o, (k, _) in aggs.items()])
    w_prev = Window.partitionBy(*partition_by).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per.select(*partition_by, "_b", *[
        (F.max if k == "max" else F.sum)(f"_t_{o}").over(w_prev).alias(f"_o_{o}")
        for o, (k, _) in aggs.items()])
    joined = ranged.join(offsets, [*partition_by, "_b"], "left")

    # (4) running value inside the bucket, plus the offset.
    end = 0 if inclusive else -1
    w_in = Window.partitionBy(*partition_by, "_b").orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, end)
    out = joined.withColumns({
        o: _combine(k, F.col(f"_o_{o}"), _AGG[k](f"_v_{o}").over(w_in))
        for o, (k, _) in aggs.items()})
    return out.drop("_b", *vals, *[f"_o_{o}" for o in aggs])


def positions(df: DataFrame, partition_by: list[str], order_by: list[str],
              out: str = "pos", buckets: int | None = None,
              bucket: Column | None = None) -> DataFrame:
    """1-based row position within each group by the order keys."""
    return running(df, partition_by, order_by, {out: ("count", F.lit(1))},
                   buckets=buckets, bucket=bucket)


def block_bucket(dense_key: Column | str, block: int = 4096) -> Column:
    """Deterministic bucket for a dense integer key: blocks of ``block`` values,
    so no bucket holds more than ``block`` rows per group."""
    return F.floor(as_col(dense_key) / F.lit(block)).cast("long")


def hash_bucket(hex_key: Column | str, digits: int = 4) -> Column:
    """Bucket for a uniform hexadecimal key: its leading digits, so 16^digits even buckets in key order."""
    return F.conv(F.substring(as_col(hex_key), 1, digits), 16, 10).cast("long")
