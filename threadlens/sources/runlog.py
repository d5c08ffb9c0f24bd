"""Run logs in ``asctime - process - level - message`` records, and the
per-epoch metrics table (append, partitioned by run).

A record starts with its time stamp and may go on over several lines (class
reports do). A log is one file a run, named after the run:
``<model>-seed-<seed>-lr<lr>-wd<weight decay>.log``. The records of an epoch have
times of their own; what ties them together is the ``Epoch`` record before them.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The record format, and the log's name.
STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}"
RECORD = rf"(?s)^({STAMP}) - (\d+) - ([A-Z]+) - (.*)$"
NEXT_RECORD = rf"\n(?={STAMP} - \d+ - [A-Z]+ - )"
MESSAGE = r"(?s)^([^:\n(]+):(?:\n | |\n)?(.*)$"
RUN_NAME = r"([^/=]+)-seed-(\d+)-lr([^/]+?)-wd([^/]+?)\.log(?:/[^/]*)?$"
ARGUMENTS = r"(?s)^Namespace\((.*)\)$"


def run_name(model: Column, seed: Column, lr: str, weight_decay: str) -> Column:
    return F.concat(model, F.lit("-seed-"), seed.cast("string"), F.lit(f"-lr{lr}-wd{weight_decay}.log"))


def format_records(df: DataFrame, keys: list[str], ts: str, process: str, messages: list[Column]) -> DataFrame:
    """(keys..., nth, value): one record a message, in order, a millisecond apart from ``ts`` on."""
    at = F.date_format(F.expr(f"timestampadd(MILLISECOND, nth, `{ts}`)"), "yyyy-MM-dd HH:mm:ss,SSS")
    e = df.select(*keys, ts, process, F.posexplode(F.array(*messages)).alias("nth", "message"))
    return e.select(*keys, "nth", F.concat_ws(" - ", at, F.col(process).cast("string"), F.lit("INFO"),
                                              F.col("message")).alias("value"))


def write_logs(records: DataFrame, name: str, order: list[str], path: str) -> str:
    """One file for each run's ``name``, its records in order."""
    (records.repartition(name).sortWithinPartitions(name, *order).select(name, "value")
     .write.mode("overwrite").partitionBy(name).text(path))
    return path


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records: model, seed, lr, weight_decay, nth, logged_at, process, level, epoch, key, value_text.

    A run's log is read whole, so that records keep their lines and their order;
    ``epoch`` is the latest ``Epoch`` up to the record (null before the first).
    A record without a key has the whole message as its value; the arguments'
    record has the key ``arguments``.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True) \
        .select(F.col("_metadata.file_path").alias("file"), "value")
    records = files.select("file", F.posexplode(F.split(F.rtrim(F.regexp_replace("value", r"\n+\z", "")),
                                                        NEXT_RECORD)).alias("nth", "record"))
    p = records.select("file", "nth", *[F.regexp_extract("record", RECORD, i).alias(n) for i, n in
                                        enumerate(("asctime", "process", "level", "message"), start=1)])
    is_args = F.col("message").rlike(ARGUMENTS)
    has_key = F.col("message").rlike(MESSAGE)
    p = p.select(
        "file", "nth", F.try_to_timestamp("asctime", F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("logged_at"),
        F.col("process").try_cast("long").alias("process"), "level",
        F.when(is_args, "arguments").when(has_key, F.regexp_extract("message", MESSAGE, 1)).alias("key"),
        F.when(is_args, F.regexp_extract("message", ARGUMENTS, 1))
        .when(has_key, F.regexp_replace(F.regexp_extract("message", MESSAGE, 2), r"\n+\z", ""))
        .otherwise(F.col("message")).alias("value_text"))
    # one window a log file
    so_far = Window.partitionBy("file").orderBy("nth")
    epoch = F.last(F.when(F.col("key") == "Epoch", F.col("value_text").try_cast("long")), ignorenulls=True)
    return p.withColumn("epoch", epoch.over(so_far)).select(
        *[F.regexp_extract("file", RUN_NAME, i).alias(n) for i, n in
          enumerate(("model", "seed", "lr", "weight_decay"), start=1)],
        "nth", "logged_at", "process", "level", "epoch", "key", "value_text") \
        .withColumns({"seed": F.col("seed").try_cast("long"), "weight_decay": F.col("weight_decay").try_cast("double")})


#: The records that hold a split's metric, and the names of splits.
SPLIT_KEY = r"(?i)^(?:best )?(train|val|validate|validation|test) (.+)$"
SPLIT_NAMES = {"val": "validate", "validation": "validate"}
SECONDS = r"^([0-9.]+) ?s$"
REPORT_ROW = r"^\s*(\S.*?)((?:\s+[0-9.]+)+)\s*$"


def log_metrics(logs: DataFrame) -> DataFrame:
    """Numbers of the records of ``read_logs``: model, seed, lr, weight_decay, epoch, split, metric, value.

    * ``Train loss``, ``Best val f1`` and the like: the split, and the metric with underscores;
    * a class report: a row for each of its cells, named ``<row>/<column>``; a row with fewer numbers
      than columns has the last ones (as the accuracy has);
    * ``time``: ``seconds``, of no split.
    Records that hold no number are left out.
    """
    run = ["model", "seed", "lr", "weight_decay", "epoch"]
    name = F.lower(F.regexp_extract("key", SPLIT_KEY, 1))
    names = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    of_split = logs.filter(F.col("key").rlike(SPLIT_KEY)).select(
        *run, F.coalesce(F.try_element_at(names, name), name).alias("split"),
        F.replace(F.regexp_extract("key", SPLIT_KEY, 2), F.lit(" "), F.lit("_")).alias("metric"), "value_text")
    single = of_split.select(*run, "split", "metric", F.col("value_text").try_cast("double").alias("value"))
    lines = F.filter(F.split("value_text", "\n"), lambda x: F.trim(x) != "")
    reports = of_split.filter(F.contains("value_text", F.lit("\n"))).withColumn("lines", lines)
    columns = F.split(F.trim(F.element_at("lines", 1)), r"\s+")
    rows = reports.select(*run, "split", columns.alias("columns"),
                          F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    rows = rows.filter(F.col("line").rlike(REPORT_ROW)).select(
        *run, "split", "columns", F.regexp_extract("line", REPORT_ROW, 1).alias("row"),
        F.split(F.trim(F.regexp_extract("line", REPORT_ROW, 2)), r"\s+").alias("cells"))
    skip = F.size("columns") - F.size("cells")
    cells = rows.filter(skip >= 0).select(*run, "split", "row", "columns", skip.alias("skip"),
                                          F.posexplode("cells").alias("at", "cell"))
    cells = cells.select(*run, "split", F.concat_ws("/", "row", F.col("columns")[F.col("at") + F.col("skip")]).alias("metric"),
                         F.col("cell").try_cast("double").alias("value"))
    times = logs.filter((F.col("key") == "time") & F.trim("value_text").rlike(SECONDS)).select(
        *run, F.lit(None).cast("string").alias("split"), F.lit("seconds").alias("metric"),
        F.regexp_extract(F.trim("value_text"), SECONDS, 1).try_cast("double").alias("value"))
    return single.union(cells).union(times).filter("value is not null")


def append_metrics(df: DataFrame, path: str, run: str = "run_id", epoch: str = "epoch",
                   partition_by: tuple[str, ...] = ("split",)) -> str:
    """Append (run, epoch, split, metric, value) rows, safe to repeat; returns the commit.

    The rows are staged in a folder of their own commit, and count only when a
    manifest names what the commit holds: (run, epoch, split). Readers take each
    from the latest commit that has it, so an append that is run again replaces
    its first try, and one that failed half-way is never seen.

    Folders follow a low-cardinality column (the split); inside the files
    rows are sorted by (run, epoch), so a filter on a run skips row groups by
    their min/max statistics. One folder per run would turn thousands of
    runs into thousands of tiny files per append; repartitioning by the
    split would leave one task per split value writing everything.
    """
    commit = stage_metrics(df, path, run, epoch, partition_by)
    staged = df.sparkSession.read.parquet(f"{path}/data/commit={commit}")
    staged.select(run, epoch, *partition_by).distinct().write.parquet(f"{path}/manifest/commit={commit}")
    return commit


def stage_metrics(df: DataFrame, path: str, run: str = "run_id", epoch: str = "epoch",
                  partition_by: tuple[str, ...] = ("split",)) -> str:
    """The first half of an append: rows that no reader sees yet."""
    commit = f"c{time.time_ns():020d}-{uuid.uuid4().hex}"  # later ones sort higher
    df.sortWithinPartitions(*partition_by, run, epoch).write.partitionBy(*partition_by) \
        .parquet(f"{path}/data/commit={commit}")
    return commit


def read_metrics(spark: SparkSession, path: str, run: str = "run_id", epoch: str = "epoch",
                 partition_by: tuple[str, ...] = ("split",)) -> DataFrame:
    """The rows of the latest commit of each (run, epoch, split)."""
    keys = [run, epoch, *partition_by]
    latest = spark.read.parquet(f"{path}/manifest").groupBy(*keys).agg(F.max("commit").alias("commit"))
    data, held = spark.read.parquet(f"{path}/data").alias("d"), latest.alias("m")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*keys, "commit")]
    return data.join(held, reduce(lambda a, b: a & b, same), "left_semi").drop("commit")
