"""The stateless steps (cleaner, statistics, lexicon counts, scaling, scoring) on streams.

They are plain column expressions, so the same functions build a streaming
plan; no state store is involved. Sinks are files with a checkpoint in the
shared folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clean, stat_columns
from ..operators.hashing import hashed_array
from ..operators.lexicon import Lexicon, lexicon_array
from ..operators.scaling import ScalerModel
from ..operators.score import FusionModel, Linear, fusion_scores, head_scores


def stream_text_features(src: DataFrame, id_col: str, text_col: str, **switches: bool) -> DataFrame:
    """(id, cleaned, six statistics) for a streaming (or batch) frame."""
    c = src.select(id_col, clean(text_col, **switches).alias("cleaned"))
    return c.select(id_col, "cleaned", *stat_columns("cleaned"))


def stream_head_scores(src: DataFrame, head: Linear, id_col: str, vec_col: str,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    x = src.select(id_col, *keep, F.col(vec_col).cast("array<double>").alias("_x"))
    return head_scores(x, head, "_x", keep=(id_col, *keep))


def stream_fusion_scores(src: DataFrame, id_col: str, text_col: str, lex: Lexicon, stats: ScalerModel,
                         counts: ScalerModel, model: FusionModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw text -> cleaner -> statistics, lexicon counts and hashed terms -> fitted scalers -> late fusion.

    All in the row: (id, keep..., logits, probs, prediction, score).
    """
    c = src.select(id_col, *keep, clean(text_col).alias("_c"))
    dim = model.content.shape[1]
    f = c.select(id_col, *keep, *stat_columns("_c"), lexicon_array("_c", lex).alias("_l"),
                 hashed_array("_c", dim).alias("_x"))
    z = f.select(id_col, *keep, "_x", F.array(*[stats.column(n, n) for n in stats.features]).alias("_zs"),
                 counts.array("_l").alias("_zl"))
    return fusion_scores(z, model, "_x", "_zs", "_zl", keep=(id_col, *keep))


def run_available_now(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process everything available, then stop; returns the finished query."""
    q = (df.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return q


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Stream the files of a folder (optionally only those matching ``glob``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def table_stream(spark: SparkSession, folder: str, name: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Stream one table of a folder, whether it is a single file or a folder of part files.

    A stream takes a single file only where the path is a pattern; this one matches the table's name alone.
    """
    return file_stream(spark, f"{folder.rstrip('/')}/[{name[0]}]{name[1:]}", schema, fmt)
