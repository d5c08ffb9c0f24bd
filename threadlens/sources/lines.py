"""Text files as numbered lines, read in parallel.

A file is cut into blocks, each read by a task of its own, and a line's place is
its block's start and its order in the block. Nothing is read twice or in
sequence: ``spark.read.text`` gives the block's start as metadata, and the lines
of a block are consecutive rows of one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells a line's file and its place there.
PLACE = ("file", "block", "at")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line) of every line; a line ends at ``\\n`` and keeps a ``\\r`` before it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
