"""Labelled split tables as CSV: one folder per split (``split=train`` ...), or
three flat files ``train.csv``, ``validate.csv`` and ``test.csv``.

Columns are found by header name, in any order and among others; a missing
column and a malformed number are errors. Quoted multi-line fields are parsed,
and the missing-value words pandas recognises become null, since Spark's CSV
reader knows a single ``nullValue``. With folders the split is a partition
column, so reading one split prunes the others' files; each file is one task. A flat
file may hold a whole split, so its lines are read in parallel (``quoted_csv``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import na_to_null
from .quoted_csv import read_quoted

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> str:
    """Write rows as CSV folders per split.

    No repartition by the split: with three split values that would leave
    three tasks writing everything. Each task writes at most one file per
    split instead (sorted by split so it holds one open file at a time).
    """
    (df.sortWithinPartitions(split_col).write.mode("overwrite").options(**CSV_OPTIONS)
     .partitionBy(split_col).csv(path))
    return path


def _number(c: Column, name: str, kind: T.DataType) -> Column:
    """A whole or decimal number, as pandas writes it (``1`` or ``1.0``); anything else is an error."""
    wide = c.try_cast("double")
    value = F.coalesce(c.try_cast(kind), F.when(wide == F.floor(wide), wide.try_cast(kind)))
    bad = F.raise_error(F.concat(F.lit(f"column {name!r} holds no number: "), c)).cast(kind)
    return F.when(c.isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce(value, bad))


def _read_by_name(spark: SparkSession, path: str, schema: str, text_cols: tuple[str, ...],
                  more: tuple[str, ...] = ()) -> DataFrame:
    header = [c for c in spark.read.options(**CSV_OPTIONS).csv(path).columns if c not in more]
    # all as text, and every file's own header must agree with the first one's
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.schema(as_text).options(**CSV_OPTIONS, enforceSchema="false").csv(path)
    return _typed(df, path, header, schema, text_cols, more)


def _typed(df: DataFrame, path: str, header: list[str], schema: str, text_cols: tuple[str, ...],
           more: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema`` from columns of text."""
    wanted = T.StructType.fromDDL(schema)
    missing = [f.name for f in wanted if f.name not in header]
    if missing:
        raise ValueError(f"{path}: no column {missing} among {header}")
    cols = []
    for f in wanted:
        c = F.col(f"`{f.name}`")
        if f.name in text_cols or not isinstance(f.dataType, T.StringType):
            c = na_to_null(c)
        cols.append((c if isinstance(f.dataType, T.StringType) else _number(c, f.name, f.dataType)).alias(f.name))
    return df.select(*cols, *more)


def read_splits(spark: SparkSession, path: str, schema: str, text_cols: tuple[str, ...],
                splits: tuple[str, ...] | None = None, split_col: str = "split") -> DataFrame:
    """Read the split folders (all, or the given ones) with NA words -> null."""
    df = _read_by_name(spark, path, schema, text_cols, more=(split_col,))
    return df if splits is None else df.filter(F.col(split_col).isin(*splits))


def read_flat_splits(spark: SparkSession, folder: str, schema: str, text_cols: tuple[str, ...],
                     splits: tuple[str, ...] = ("train", "validate", "test"),
                     split_col: str = "split") -> DataFrame:
    """Read ``<folder>/<split>.csv`` for each split; files may order their columns differently."""
    out = None
    for split in splits:
        path = f"{folder.rstrip('/')}/{split}.csv"
        rows = read_quoted(spark, path)
        part = _typed(rows, path, rows.columns, schema, text_cols).withColumn(split_col, F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out
