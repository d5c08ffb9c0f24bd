"""Lexicon dictionaries in the ``%``-delimited ``.dic`` text format.

    %
    1<TAB>function
    2<TAB>th_words
    %
    the<TAB>1
    th*<TAB>2

Lines are classified by shape, so the file is read in parallel: a header line is
``<number><TAB><name>`` with a non-numeric name; a term line is
``<pattern>(<TAB><number>)+``. Categories keep the order of their lines, whatever
their numbers; a term's number that no header line has is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexicon import Lexicon, build_lexicon
from ..operators.util import broadcast_if_bounded
from .lines import PLACE, numbered_lines


def read_dic_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, block, at, id, category) and (pattern, category) tables of a .dic file."""
    lines = numbered_lines(spark, path).withColumn("line", F.regexp_replace("line", "\r$", ""))
    lines = lines.filter((F.col("line") != "") & (F.col("line") != "%"))
    fields = lines.select(*PLACE, F.split("line", "\t").alias("f"))
    is_head = (F.size("f") == 2) & F.element_at("f", 1).rlike("^[0-9]+$") \
        & ~F.element_at("f", 2).rlike("^[0-9]+$")
    cats = fields.filter(is_head).select(
        *PLACE, F.element_at("f", 1).cast("int").alias("id"), F.element_at("f", 2).alias("category"))
    terms = fields.filter(~is_head & (F.size("f") >= 2)).select(
        F.element_at("f", 1).alias("pattern"),
        F.explode(F.slice("f", 2, F.size("f"))).alias("id_s"))
    number = F.when(F.col("id_s").rlike("^[0-9]+$"), F.col("id_s").cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("lexicon term with a category that is no number: "), "pattern")).cast("int"))
    terms = terms.select("pattern", number.alias("id"))
    names = broadcast_if_bounded(cats.select("id", F.col("category").alias("name")), cats.count())
    unknown = F.raise_error(F.concat(F.lit("lexicon term with an unknown category number: "), "pattern")).cast("string")
    pairs = terms.join(names, "id", "left").select("pattern", F.coalesce("name", unknown).alias("category"))
    return cats, pairs


def read_dic(spark: SparkSession, path: str) -> Lexicon:
    """Load a dictionary; categories keep the order of the file."""
    cats, pairs = read_dic_tables(spark, path)
    order = [r["category"] for r in cats.orderBy(*PLACE).collect()]  # a dictionary is small
    return build_lexicon(pairs, order)


def write_dic(spark: SparkSession, categories: list[str], pairs, path: str, numbers: list[int] | None = None) -> str:
    """Write a .dic file (one text part) from categories, in order, and (pattern, category)."""
    ids = dict(zip(categories, numbers or range(1, len(categories) + 1)))
    by_pat: dict[str, list[int]] = {}
    for pat, cat in pairs:
        by_pat.setdefault(pat, []).append(ids[cat])
    lines = ["%"] + [f"{i}\t{c}" for c, i in ids.items()] + ["%"] + [
        pat + "".join(f"\t{i}" for i in sorted(v)) for pat, v in by_pat.items()]
    spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)
    return path
