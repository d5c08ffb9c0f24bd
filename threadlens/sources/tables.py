"""The driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Unique key of each table we read: spreading on it cannot skew.
TABLE_KEYS = {
    "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",),
    "conversations": ("conv_id", "turn"), "embeddings": ("vec_id",),
    "events": ("event_id",), "benchmark": ("item_id",),
}


#: Session option: deal every scan out to so many partitions of its key. Unset
#: (the default), a scan has the partitions of its files. It is for tables kept in
#: one row group, as in the tests and the bench; no plan depends on an input's size.
SCAN_PARTITIONS = "threadlens.scanPartitions"


def deal(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Hash-partition a scan on its unique key if the session asks for it."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n), *keys) if n else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition rows on these columns before costly work on each row.

    A scan has no more tasks than its files have row groups, and one row group can
    hold a whole table. The partitions are the session's number for shuffles: named,
    it is not lowered for few bytes, since the work follows. A text among the columns
    parts rows whose keys are null or repeat.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the parquet scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return deal(df, TABLE_KEYS[name]) if name in TABLE_KEYS else df
