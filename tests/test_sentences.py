"""Abbreviations learnt from a corpus, and sentences counted with them."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.functions import sentence_count
from threadlens.operators.sentences import Abbreviations, abbreviations, period_counts

WORDS = "the train left home early and nobody saw it there until night came over hill town river".split()


def corpus(spark, n=300):
    """Plain prose in which a few words carry a period wherever they stand."""
    rng = random.Random(0)
    texts = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(8, 20))]
        at = rng.randrange(1, len(words) - 1)
        words[at] = rng.choice(["Dr. Smith", "Mr. Jones", "5 p.m. today", "e.g. this"])
        texts.append(" ".join(words).capitalize() + ". " + " ".join(rng.sample(WORDS, 5)).capitalize() + ".")
    return spark.createDataFrame([(t.replace("mr. jones", "Mr. Jones").replace("dr. smith", "Dr. Smith"),)
                                  for t in texts], "t string")


@pytest.fixture(scope="module")
def learnt(spark):
    return Abbreviations.fit(corpus(spark), "t")


def test_abbreviations_are_told_from_last_words(learnt):
    assert set(learnt.titles) == {"dr", "mr"} and set(learnt.others) == {"p.m", "e.g"}


@pytest.mark.parametrize("text, n", [
    ("Dr. Smith met Mr. Jones at 5 p.m. today.", 1), ("He left at 5 p.m. She stayed.", 2), ("It was Mr. Mr. Jones.", 1),
    ("See e.g. p.m. e.g. this. And that.", 2), ("MR. JONES! Who?", 2), ("omr. He. Drdr. It", 4), ("", 0), (None, 0),
    ("p.m.\n  later. Then", 2)])
def test_sentences(spark, learnt, text, n):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(learnt.sentence_count("t")).first()[0] == n


def test_nothing_to_learn(spark):
    for texts in ([], [("",)], [(None,)], [("no periods here at all",)], [("A. A. A.",)]):
        df = spark.createDataFrame(texts, "t string")
        found = Abbreviations.fit(df, "t")
        assert not found.others
    plain = spark.createDataFrame([("One. Two. Three.",)], "t string")
    none = Abbreviations([], [])
    assert plain.select(none.sentence_count("t")).first()[0] == plain.select(sentence_count("t")).first()[0] == 3


def test_no_more_than_the_bound(spark):
    counts = period_counts(corpus(spark), "t")
    assert abbreviations(counts, most=2).count() == 2
    top = abbreviations(counts).orderBy(F.desc("score"), "word").limit(2).collect()
    assert sorted(r.word for r in abbreviations(counts, most=2).collect()) == sorted(r.word for r in top)
