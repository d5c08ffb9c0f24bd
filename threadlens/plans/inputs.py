"""Inputs derived from the driver's tables, in Spark and as SQL text.

Every registered query reads the tables (or what Spark derives from them);
the small inline rows below are only ever appended to a table's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, spread
from . import sqltext

# Split of a labelled row by its id: 0-7 train, 8 validate, 9 test.
SPLITS = ("train", "validate", "test")


def split_of(id_col: Column | str) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    r = F.pmod(c, F.lit(10))
    return (F.when(r <= 7, F.lit("train")).when(r == 8, F.lit("validate"))
            .otherwise(F.lit("test")))


def split_sql(id_expr: str) -> str:
    return (f"CASE WHEN ({id_expr}) % 10 <= 7 THEN 'train' "
            f"WHEN ({id_expr}) % 10 = 8 THEN 'validate' ELSE 'test' END")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as posts: title from the page head, body = the raw page.

    ``text`` (url, space, html) carries links, entities and markup marks.
    """
    p = read_table(spark, sf, "pages")
    return p.select(
        F.col("page_id").alias("post_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("body"),
        F.concat_ws(" ", "url", "html").alias("text"))


POSTS_SQL = ("(SELECT page_id AS post_id, "
             "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, "
             "html AS body, concat_ws(' ', url, html) AS text FROM pages)")

# Hand-written edge cases appended to table rows (negative ids).
EDGE_TEXTS = (
    'length &gt; strength "\\&gt;x gt',
    "Wow! Great!! ok! x",
    "a\r\n\r\nb\tc \t d\x85e\xa0\xa0f g",
    "http://a.b/c).　next https://x\xa0y",
    "x^(2 ^(3)) ~~s~~ `c` ",
    "|a|b|\n|:-|:-|",
    "# H &amp;#x200B; &amp;amp; &amp;lt;",
    "!a\rb! !c d!",
    "!a\x0bb!",
    "a!b c!d",
    "",
    "  ",
    None,
    "\x1c a \x1f",
    "g*t",
    "digits ²③٣ 5 ১",
    "\U0001F44D\U0001F3FD \U0001F468‍\U0001F469‍\U0001F467 "
    "\U0001F1EB\U0001F1F7\U0001F1E9\U0001F1EA ❤️ 1️⃣ \U0001F600\U0001F600",
    "Hi there. How are you?! I'm \"fine.\" ok",
)


def edge_rows(spark: SparkSession, id_name: str = "id", text_name: str = "text") -> DataFrame:
    rows = [(-(i + 1), t) for i, t in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, f"{id_name} long, {text_name} string")


def edge_rows_sql(id_name: str = "id", text_name: str = "text") -> str:
    vals = ", ".join(
        f"({-(i + 1)}, {'CAST(NULL AS VARCHAR)' if t is None else sqltext.lit(t)})"
        for i, t in enumerate(EDGE_TEXTS))
    return f"(SELECT * FROM (VALUES {vals}) AS e({id_name}, {text_name}))"


def documents_with_edges(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return d.unionByName(edge_rows(spark))


DOCS_EDGES_SQL = (f"(SELECT doc_id AS id, text FROM documents UNION ALL "
                  f"SELECT * FROM {edge_rows_sql()})")


def posts_with_edges(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf).select(F.col("post_id").alias("id"), "text")
    return p.unionByName(edge_rows(spark))


POSTS_EDGES_SQL = (f"(SELECT post_id AS id, text FROM {POSTS_SQL} UNION ALL "
                   f"SELECT * FROM {edge_rows_sql()})")


# An invented lexicon. Categories in dictionary order, then
# (pattern, category) pairs; a trailing * marks a stem. "the" is shadowed by
# "th*", "the*" and "thr*" by "th*", "ret*" by "re*"; "unused" never matches.
LEXICON_CATEGORIES = ("function", "th_words", "re_words", "romance", "german",
                      "quantity", "unused")
LEXICON_PAIRS = (
    ("th*", "th_words"), ("the", "function"), ("the*", "function"), ("thr*", "quantity"),
    ("and", "function"), ("of", "function"), ("on", "function"), ("is", "function"),
    ("by", "function"), ("with", "function"), ("re*", "re_words"), ("ret*", "re_words"),
    ("le", "romance"), ("la", "romance"), ("des", "romance"), ("et", "romance"),
    ("el", "romance"), ("los", "romance"), ("und", "german"), ("der", "german"),
    ("die", "german"), ("ein*", "german"), ("one", "quantity"), ("many", "quantity"),
    ("many", "function"), ("zzq*", "unused"),
)


def lexicon_sql() -> str:
    vals = ", ".join(f"({sqltext.lit(p)}, {sqltext.lit(c)})" for p, c in LEXICON_PAIRS)
    return f"(SELECT * FROM (VALUES {vals}) AS t(pattern, category))"


def categories_sql() -> str:
    vals = ", ".join(f"({sqltext.lit(c)}, {i})" for i, c in enumerate(LEXICON_CATEGORIES))
    return f"(SELECT * FROM (VALUES {vals}) AS t(category, ord))"


def token_category_ctes(texts_sql: str) -> str:
    """CTEs toks(id, tok) and tc(tok, category) for texts_sql(id, c).

    Resolution by a different route than Spark's: per distinct token, the
    shortest stem that prefixes it, else the exact word.
    """
    return f"""
lex AS {lexicon_sql()},
pat AS (SELECT DISTINCT CASE WHEN suffix(pattern, '*') THEN left(pattern, length(pattern) - 1)
               ELSE pattern END AS stem, suffix(pattern, '*') AS wild, category FROM lex),
toks AS (SELECT id, unnest({sqltext.lexicon_tokens('c')}) AS tok FROM {texts_sql}),
dt AS (SELECT DISTINCT tok FROM toks),
wm AS (SELECT d.tok, min(length(p.stem)) AS l FROM dt d JOIN pat p
       ON p.wild AND starts_with(d.tok, p.stem) GROUP BY d.tok),
tc AS (SELECT wm.tok, p.category FROM wm JOIN pat p ON p.wild AND p.stem = left(wm.tok, wm.l)
       UNION ALL
       SELECT d.tok, p.category FROM dt d JOIN pat p ON NOT p.wild AND p.stem = d.tok
       WHERE NOT EXISTS (SELECT 1 FROM wm WHERE wm.tok = d.tok))"""


def cleaned_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, split, c): documents with the full cleaner applied."""
    from ..functions import clean
    d = documents(spark, sf)
    return d.select("doc_id", split_of("doc_id").alias("split"), clean("text").alias("c"))


def spread_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, split, c) as ``cleaned_docs``, but cleaned in as many tasks as a shuffle has, however the table is laid out."""
    from ..functions import clean
    d = spread(documents(spark, sf).select("doc_id", "text"), "doc_id", "text")
    return d.select("doc_id", split_of("doc_id").alias("split"), clean("text").alias("c"))


CLEANED_DOCS_SQL = (f"(SELECT doc_id AS id, {split_sql('doc_id')} AS split, "
                    f"{sqltext.clean('text')} AS c FROM documents)")
