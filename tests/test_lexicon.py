"""Lexicon matching vs. a brute-force trie walk, zero fill, .dic round trip."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from threadlens.operators.lexicon import lexicon_counts, lexicon_from_pairs, lexicon_vector
from threadlens.plans import inputs as I
from threadlens.session import scratch_path
from threadlens.sources.lexicon_file import read_dic, write_dic

FIX_CATS = ["c1", "c2", "c3", "c4"]
FIX_PAIRS = [("th*", "c1"), ("the", "c2"), ("of", "c3"), ("on", "c3"), ("re*", "c2")]


def trie_categories(pairs, token):
    """Shortest matching stem wins, else the exact word (brute force)."""
    stems = sorted({p[:-1] for p, _ in pairs if p.endswith("*")}, key=len)
    for s in stems:
        if token.startswith(s):
            return sorted(c for p, c in pairs if p == s + "*")
    return sorted(c for p, c in pairs if p == token)


def test_fixture_semantics(spark):
    lex = lexicon_from_pairs(spark, FIX_PAIRS, FIX_CATS)
    df = spark.createDataFrame([(1, "The theory of rest, on them."), (2, ""), (3, None)], "id long, t string")
    v = {r.id: r.lex_vec for r in lexicon_vector(df, "id", "t", lex).collect()}
    # the, theory, them -> c1 (th* shadows the); of, on -> c3; rest -> c2
    assert v[1] == [3, 1, 2, 0]
    assert v[2] == [0, 0, 0, 0] and v[3] == [0, 0, 0, 0]


def test_against_brute_force_on_documents(spark):
    lex = lexicon_from_pairs(spark, I.LEXICON_PAIRS, list(I.LEXICON_CATEGORIES))
    d = I.cleaned_docs(spark, SF01).limit(200)
    got = {(r.doc_id, r.category): r.n for r in lexicon_counts(d, "doc_id", "c", lex).collect()}
    import re
    want = Counter()
    for r in d.collect():
        for tok in re.findall(r"\w+", (r.c or "").lower()):
            for c in trie_categories(I.LEXICON_PAIRS, tok):
                want[(r.doc_id, c)] += 1
    assert got == dict(want)


def test_dic_round_trip(spark):
    path = scratch_path(spark, "test-dic")
    write_dic(spark, FIX_CATS, FIX_PAIRS, path)
    lex = read_dic(spark, path)
    assert lex.categories == FIX_CATS
    df = spark.createDataFrame([(1, "the rest of it")], "id long, t string")
    assert lexicon_vector(df, "id", "t", lex).first().lex_vec == [1, 1, 1, 0]


def test_no_nested_loop_join(spark):
    lex = lexicon_from_pairs(spark, FIX_PAIRS, FIX_CATS)
    df = spark.createDataFrame([(1, "the rest")], "id long, t string")
    plan = lexicon_vector(df, "id", "t", lex)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_found_keys_count_as_tokens_do(spark):
    """Vectors, counts and the row-wise vector agree with matching each token, whatever the patterns."""
    from pyspark.sql import functions as F
    from threadlens import functions as tf
    from threadlens.operators import lexicon as LX

    texts = ["The thread, their THE of re-run ret_1 and 've théâtre", "", None, "of of ofthe x1 1x Ünder under \U0001F600the", " a  b "]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, c string")
    for pairs in ([("th*", "a"), ("the", "b"), ("of", "b"), ("of", "a"), ("ün*", "c"), ("1*", "c"), ("a b", "b"), (" ", "a")],
                  [("*", "a"), ("the", "b")], [("zzz", "a")], [("'ve", "a")], [("", "a"), ("x*", "b")]):
        lex = LX.lexicon_from_pairs(spark, pairs, ["a", "b", "c"])
        toks = d.select("id", F.explode(tf.lexicon_tokens("c")).alias("tok"))
        want = {(r.id, r.category): r.n for r in LX.match_tokens(toks, "tok", lex).groupBy("id", "category").agg(
            F.count(F.lit(1)).alias("n")).collect()}
        assert {(r.id, r.category): r.n for r in LX.lexicon_counts(d, "id", "c", lex).collect()} == want, pairs
        for got in (LX.lexicon_vector(d, "id", "c", lex), d.select("id", LX.lexicon_array("c", lex).alias("lex_vec"))):
            assert {r.id: r.lex_vec for r in got.collect()} == {
                i: [want.get((i, c), 0) for c in "abc"] for i in range(len(texts))}, pairs


def test_spark_classes_hold_the_same_characters(spark):
    from pyspark.sql import functions as F
    from threadlens.functions import patterns as P

    every = spark.range(0x110000).filter("id < 55296 or id >= 57344").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    for plain, fast in ((f"[{P.WS}]", P.WS_SPARK), (P.DIGIT, P.DIGIT_SPARK), (P.EMOJI_BASE, P.EMOJI_BASE_SPARK),
                        (P.LEXICON_CHAR, P.LEXICON_CHAR_SPARK)):
        assert every.filter(F.col("c").rlike(plain) != F.col("c").rlike(fast)).count() == 0
