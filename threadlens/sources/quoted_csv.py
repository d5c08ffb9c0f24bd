"""One large quoted CSV file, read by many tasks.

A quoted field may hold line breaks, so Spark's reader gives such a file to one
task. Here its physical lines are read in parallel and put together again:

1. the quotes of each line are counted; a line starts a record if the quotes
   before it are even (an escaped quote is two, so it changes nothing);
2. their running sum is one total a block, offsets over these, and a running sum
   inside each block, over counts alone: no text takes part;
3. lines that hold a whole record are parsed as they are; the lines of the
   others meet by record, in order;
4. each record is parsed by ``from_csv`` with the options of the reader.

Files have a header, the same in all files of a folder, and their quotes are
balanced; anything else is an error. Empty lines between records are skipped. In records
that end with CRLF, line breaks inside quotes become LF, as Spark's own reader has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import running
from ..session import materialize
from .lines import PLACE, numbered_lines

#: Quoting as the split files have it, and line breaks inside quotes kept as they are.
FIELD_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true",
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, at, rec, n): the place of the first line of each line's record, and the record's lines."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counts = materialize(lines.select(*PLACE, quotes.cast("long").alias("q")))
    odd = counts.groupBy("file").agg((F.sum("q") % 2 == 1).alias("odd")).filter("odd").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].file}: a quoted field does not end")
    before = running(counts, ["file"], ["block", "at"], {"before": ("sum", "q")}, inclusive=False,
                     bucket=F.col("block"))
    starts = F.when(F.coalesce("before", F.lit(0)) % 2 == 0, F.struct("block", "at"))
    recs = running(before.withColumn("start", starts), ["file"], ["block", "at"], {"rec": ("max", "start")},
                   bucket=F.col("block"))
    sizes = Window.partitionBy("file", "rec")
    return recs.select(*PLACE, "rec", F.count(F.lit(1)).over(sizes).alias("n"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, record): the text of every record, header included, without its line end."""
    lines = numbered_lines(spark, path)
    placed = lines.join(_starts(lines), list(PLACE))
    whole = placed.filter("n = 1").select("file", "rec", F.col("line").alias("record"))
    parts = placed.filter("n > 1").groupBy("file", "rec").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))
    joined = parts.select("file", "rec", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"))
    crlf = F.replace(F.regexp_replace("record", r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))
    record = F.when(F.col("record").endswith("\r"), crlf).otherwise(F.col("record"))
    return whole.union(joined).withColumn("record", record).filter("record <> ''")


def _names(spark: SparkSession, header: str) -> list[str]:
    """The column names of a header record; a name that is empty is ``_c`` and its number."""
    most = ", ".join(f"c{i} string" for i in range(header.count(",") + 1))
    row = spark.range(1).select(F.from_csv(F.lit(header), most, FIELD_OPTIONS).alias("r")).first().r
    last = max(i for i, name in enumerate(row) if name is not None)
    return [name or f"_c{i}" for i, name in enumerate(row[:last + 1])]


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the file (or folder of files) as text, named by the header."""
    records = read_records(spark, path)
    first = records.groupBy("file").agg(F.min(F.struct("rec", "record")).alias("first")).select("file", "first.*")
    headers = [r.record for r in first.select("record").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"{path}: files with different headers {headers}" if headers else f"{path}: no header")
    schema = ", ".join(f"`{n}` string" for n in _names(spark, headers[0]))
    rows = records.join(first.select("file", "rec"), ["file", "rec"], "left_anti")
    return rows.select(F.from_csv("record", schema, FIELD_OPTIONS).alias("r")).select("r.*")
