"""Sentence counts with abbreviations learnt from the corpus.

A period after an abbreviation ends no sentence. Which words are abbreviations is
learnt from counts alone (Kiss and Strunk, 2006): a word scores high if it is nearly
always written with a period, far more often than words are in general (a
log-likelihood ratio of two binomials), is short, holds periods itself, and is not
seen without its last one. Titles, mostly followed by a capital, never end a
sentence; other abbreviations do before a capital.

Counting is one aggregate over (word, period, next word's case) with map-side partial
sums; the abbreviations are at most ``MOST``, the highest scores first, and are put
into the splitter as a pattern, so applying them is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import DOTTED_WORD, WS
from ..functions.text import fill_empty, sentence_count
from .util import as_col

#: Abbreviations kept, least score, and the chance of a period after an abbreviation.
MOST = 500
LEAST_SCORE = 0.3
SURE = 0.99


def period_counts(df: DataFrame, text: Column | str) -> DataFrame:
    """(word, n, n_dot, n_upper, n_lower): occurrences of a word in lower case, with a period, and those of them
    whose next word is capitalised or not."""
    words = F.regexp_extract_all(fill_empty(as_col(text)), F.lit(DOTTED_WORD), 0)

    def seen(own: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            after = F.substring(F.try_element_at(own, i + 2), 1, 1)
            dot = w.endswith(".")
            return F.struct(F.lower(F.regexp_replace(w, r"\.$", "")).alias("word"), dot.alias("dot"),
                            (dot & (after != F.lower(after))).alias("upper"),
                            (dot & (after == F.lower(after))).alias("lower"))
        return F.transform(own, one)

    rows = df.select(words.alias("_w")).select(F.inline(seen(F.col("_w"))))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("dot").alias("n_dot"),
                                    F.count_if("upper").alias("n_upper"), F.count_if("lower").alias("n_lower"))


def abbreviations(counts: DataFrame, most: int = MOST) -> DataFrame:
    """(word, score, title) of the abbreviations among ``period_counts``."""
    total = counts.agg(F.sum("n").alias("all"), F.sum("n_dot").alias("dots")).first()
    if not total["dots"] or total["dots"] == total["all"]:
        p = 0.5
    else:
        p = total["dots"] / total["all"]
    k, other = F.col("n_dot").cast("double"), (F.col("n") - F.col("n_dot")).cast("double")
    ratio = 2 * (k * F.log(F.lit(SURE / p)) + other * F.log(F.lit((1 - SURE) / (1 - p))))
    inner = F.length(F.regexp_replace("word", r"[^.]", ""))
    letters = F.length("word") - inner
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -other)
    found = counts.filter("n_dot > 0").select("word", score.alias("score"), (F.col("n_upper") >= F.col("n_lower")).alias("title"))
    return found.filter(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), "word").limit(most)


@dataclass
class Abbreviations:
    """Learnt words in lower case, at most ``MOST``: titles, and those that may end a sentence."""

    titles: list[str]
    others: list[str]

    @classmethod
    def fit(cls, df: DataFrame, text: Column | str, most: int = MOST) -> "Abbreviations":
        rows = abbreviations(period_counts(df, text), most).collect()
        return cls(sorted(r.word for r in rows if r.title), sorted(r.word for r in rows if not r.title))

    def _pattern(self, words: list[str]) -> str:
        ways = "|".join(w.replace(".", r"\.") for w in sorted(words, key=lambda w: (-len(w), w)))
        return rf"(?<![\p{{L}}.])((?iu:{ways}))\."

    def protected(self, text: Column | str) -> Column:
        """The text without the periods that end no sentence."""
        out = fill_empty(as_col(text))
        if self.titles:
            out = F.regexp_replace(out, self._pattern(self.titles), "$1")
        if self.others:
            out = F.regexp_replace(out, self._pattern(self.others) + rf"(?=[{WS}]+[^\p{{Lu}}{WS}])", "$1")
        return out

    def sentence_count(self, text: Column | str) -> Column:
        return sentence_count(self.protected(text))
