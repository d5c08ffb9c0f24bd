"""Registered queries: cleaner stages, post assembly and text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..functions.patterns import DOTTED_WORD, WS
from ..functions.text import STAT_NAMES
from ..operators.sentences import LEAST_SCORE, MOST, SURE, Abbreviations
from . import inputs as I
from . import sqltext as S
from ..sources.tables import read_table
from .registry import register


def _stage_query(table_fn, table_sql, **switches):
    off = {k: False for k in ("newline", "quote", "bullet_point", "link", "strikethrough",
                              "spoiler", "code", "superscript", "table", "heading")}
    off.update(switches)

    def q(spark, sf):
        return table_fn(spark, sf).select("id", tf.clean("text", **off).alias("cleaned"))

    sql = f"SELECT id, {S.clean('text', **off)} AS cleaned FROM {table_sql}"
    return q, sql


for _name, _fn, _sql, _sw in (
    ("clean_newline_trim", I.documents_with_edges, I.DOCS_EDGES_SQL, {"newline": True}),
    ("clean_quote", I.posts_with_edges, I.POSTS_EDGES_SQL, {"quote": True}),
    ("clean_bullets", I.posts_with_edges, I.POSTS_EDGES_SQL, {"bullet_point": True}),
    ("clean_links", I.posts_with_edges, I.POSTS_EDGES_SQL, {"link": True}),
    ("clean_strike_spoiler", I.documents_with_edges, I.DOCS_EDGES_SQL,
     {"strikethrough": True, "spoiler": True}),
    ("clean_code_superscript", I.documents_with_edges, I.DOCS_EDGES_SQL,
     {"code": True, "superscript": True}),
    ("clean_table_heading", I.documents_with_edges, I.DOCS_EDGES_SQL,
     {"table": True, "heading": True}),
):
    _q, _s = _stage_query(_fn, _sql, **_sw)
    register(_name, _s)(_q)


@register("clean_full", f"SELECT id, {S.clean('text')} AS cleaned FROM {I.POSTS_EDGES_SQL}")
def clean_full(spark, sf):
    """All ten switches on, over every post plus the edge cases."""
    return I.posts_with_edges(spark, sf).select("id", tf.clean("text").alias("cleaned"))


_FLAGS_OFF = {"quote": False, "link": False, "table": False}


@register("clean_flags_off",
          f"SELECT conv_id, turn, {S.clean('text', **_FLAGS_OFF)} AS cleaned FROM conversations")
def clean_flags_off(spark, sf):
    """Replies cleaned with the quote, link and table stages switched off."""
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tf.clean("text", **_FLAGS_OFF).alias("cleaned"))


_POST_SQL = "concat_ws(' ', title, body)"


@register("post_concat_clean",
          f"SELECT post_id, {S.clean(_POST_SQL)} AS content_cleaned FROM {I.POSTS_SQL}")
def post_concat_clean(spark, sf):
    """A post = title + ' ' + body, cleaned (links become [URL])."""
    p = I.posts(spark, sf)
    return p.select("post_id", tf.post_text("title", "body").alias("content_cleaned"))


def _stats_sql(expr):
    return ", ".join(f"{e} AS {n}" for e, n in zip(S.stat_exprs(expr), STAT_NAMES))


@register("text_stats",
          f"SELECT doc_id, {_stats_sql('c')} FROM "
          f"(SELECT doc_id, {S.clean('text')} AS c FROM documents)")
def text_stats(spark, sf):
    """Six statistics of each cleaned document."""
    d = I.documents(spark, sf).select("doc_id", tf.clean("text").alias("c"))
    return d.select("doc_id", *tf.stat_columns("c"))


@register("stat_vector",
          "SELECT doc_id, array_to_string(list_transform(["
          + ", ".join(f"CAST({e} AS DOUBLE)" for e in S.stat_exprs("c"))
          + "], lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS stat_vec FROM "
          f"(SELECT doc_id, {S.clean('text')} AS c FROM documents)")
def stat_vector(spark, sf):
    """The statistics as one array<double> in fixed order (shown joined)."""
    d = I.documents(spark, sf).select("doc_id", tf.clean("text").alias("c"))
    v = tf.stat_vector("c")
    return d.select("doc_id", F.array_join(
        F.transform(v, lambda x: x.cast("long").cast("string")), ",").alias("stat_vec"))


@register("url_emoji_digit_counts",
          f"SELECT id, {S.url_count('c')} AS n_urls, {S.emoji_count('c')} AS n_emoji, "
          f"{S.digit_count('c')} AS n_digits, {S.sentence_count('c')} AS n_sentences FROM "
          f"(SELECT id, {S.clean('text', spoiler=False)} AS c FROM {I.POSTS_EDGES_SQL})")
def url_emoji_digit_counts(spark, sf):
    """Link placeholders, emoji and digits of cleaned posts and edge cases."""
    p = I.posts_with_edges(spark, sf).select("id", tf.clean("text", spoiler=False).alias("c"))
    return p.select("id", tf.url_count("c").alias("n_urls"), tf.emoji_count("c").alias("n_emoji"),
                    tf.digit_count("c").alias("n_digits"),
                    tf.sentence_count("c").alias("n_sentences"))


_PROFILE_SQL = (
    "SELECT l.quality, CAST(count(*) AS BIGINT) AS n_docs, "
    + ", ".join(f"round(avg(s.{n}), 6) AS avg_{n[2:]}" for n in STAT_NAMES)
    + f" FROM (SELECT doc_id, {_stats_sql('c')} FROM "
      f"(SELECT doc_id, {S.clean('text')} AS c FROM documents)) s "
      "JOIN labels l ON s.doc_id = l.doc_id GROUP BY l.quality")


@register("quality_profile", _PROFILE_SQL)
def quality_profile(spark, sf):
    """Do accepted texts differ in length, links, emoji and digits?

    Statistics are computed where the text is read, so only seven longs per
    document cross the join shuffle; the per-quality averages aggregate
    partially on the map side.
    """
    # two steps, so that the cleaned text is computed once and not in each statistic
    d = I.documents(spark, sf).select("doc_id", tf.clean("text").alias("c")).select("doc_id", *tf.stat_columns("c"))
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id")
    return j.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.round(F.avg(n), 6).alias(f"avg_{n[2:]}") for n in STAT_NAMES])


_WAYS = "string_agg(replace(word, '.', chr(92) || '.'), '|' ORDER BY length(word) DESC, word)"
_BEFORE = "(^|[^\\p{L}.])((?i:"
_LOWER_AFTER = rf"))\.([{WS}]+[^\p{{Lu}}{WS}])"


def _learnt_sql() -> str:
    titles = f"({S.lit(_BEFORE)} || titles || {S.lit('))' + chr(92) + '.')})"
    others = f"({S.lit(_BEFORE)} || others || {S.lit(_LOWER_AFTER)})"
    no_titles = f"CASE WHEN titles IS NULL THEN text ELSE regexp_replace(text, {titles}, '\\1\\2', 'g') END"
    # a match takes the character that the next one needs before it: twice
    once = f"regexp_replace(c, {others}, '\\1\\2\\3', 'g')"
    twice = f"regexp_replace({once}, {others}, '\\1\\2\\3', 'g')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT regexp_extract_all(text, {S.lit(DOTTED_WORD)}) AS ws FROM d),
t AS (SELECT unnest(ws) AS w, unnest(list_concat(ws[2:], [NULL])) AS after FROM w),
c AS (SELECT lower(regexp_replace(w, {S.lit(chr(92) + '.$')}, '')) AS word, count(*) AS n, count_if(suffix(w, '.')) AS k,
      count_if(suffix(w, '.') AND left(after, 1) <> lower(left(after, 1))) AS up,
      count_if(suffix(w, '.') AND left(after, 1) = lower(left(after, 1))) AS low FROM t GROUP BY 1),
p AS (SELECT sum(k) / sum(n)::DOUBLE AS p FROM c),
a AS (SELECT word, up >= low AS title, length(word) - length(replace(word, '.', '')) AS inside,
      2 * (k * ln({SURE} / p) + (n - k) * ln((1 - {SURE}) / (1 - p))) AS ratio, n - k AS other FROM c, p WHERE k > 0),
s AS (SELECT word, title, ratio * exp(-(length(word) - inside)) * (inside + 1)
      * pow((length(word) - inside)::DOUBLE, -other::DOUBLE) AS score FROM a),
f AS (SELECT * FROM s WHERE score >= {LEAST_SCORE} ORDER BY score DESC, word LIMIT {MOST}),
ways AS (SELECT {_WAYS} FILTER (title) AS titles, {_WAYS} FILTER (NOT title) AS others FROM f),
one AS (SELECT doc_id, others, {no_titles} AS c FROM d, ways),
two AS (SELECT doc_id, CASE WHEN others IS NULL THEN c ELSE {twice} END AS c FROM one)
SELECT doc_id, {S.sentence_count('c')} AS n_sentences FROM two"""


@register("learnt_sentences", _learnt_sql())
def learnt_sentences(spark, sf):
    """Sentences of each document, periods of abbreviations that the corpus itself teaches left aside."""
    d = I.documents(spark, sf)
    learnt = Abbreviations.fit(d, "text")
    return d.select("doc_id", learnt.sentence_count("text").alias("n_sentences"))
