"""What the operators of this folder share: reading tables, cutting lineage, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import shared_dir

#: The six separators of a word; a word is a run of anything else.
SEPARATORS = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch: texts can be long, so batches are kept short.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that extra columns cannot clash with derived ones."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*columns)


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage through a checkpoint in the cluster's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
