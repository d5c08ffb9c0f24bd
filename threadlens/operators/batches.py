"""Seeded shuffling and fixed-size batches without a global sort in one task.

The shuffled order of a split is the order of ``md5(id:seed:epoch)`` - a
stable pseudo-random key that does not depend on partitioning (unlike
``rand()``). Positions come from the distributed running count, so the
numbering of a huge split is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import block_bucket, hash_bucket, positions
from .util import as_col


def shuffle_key(id_col: Column | str, seed: int, epoch: int) -> Column:
    return F.md5(F.concat_ws(":", as_col(id_col).cast("string"), F.lit(str(seed)),
                             F.lit(str(epoch))))


def assign_batches(df: DataFrame, id_col: str, split_col: str = "split", batch_size: int = 16,
                   shuffled_splits: tuple[str, ...] = ("train",), seed: int = 42,
                   epoch: int = 0) -> DataFrame:
    """Add ``pos`` (1-based, within split) and ``batch_id``.

    Shuffled splits are ordered by the seeded key; the others by id.
    """
    shuffled = F.col(split_col).isin(*shuffled_splits)
    keyed = df.withColumns({
        "_k1": F.when(shuffled, shuffle_key(id_col, seed, epoch)).otherwise(F.lit("")),
        "_k2": F.col(id_col)})
    # shuffled splits by leading digits of the key, the others by blocks of ids: neither needs a sample
    bucket = F.when(shuffled, hash_bucket("_k1")).otherwise(block_bucket(id_col))
    p = positions(keyed, [split_col], ["_k1", "_k2"], out="pos", bucket=bucket)
    return p.withColumn("batch_id", F.floor((F.col("pos") - 1) / batch_size).cast("long")) \
        .drop("_k1", "_k2")
