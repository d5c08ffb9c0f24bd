"""Text statistics on the hand-made fixtures."""

from pyspark.sql import functions as F

from threadlens.functions import (char_count, digit_count, emoji_count, lexicon_tokens,
                                  sentence_count, stat_vector, url_count, word_count)


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn("t")).first()[0]


def test_digits_like_isdigit(spark):
    s = "²③٣ 5 ১"
    assert one(spark, digit_count, s) == sum(ch.isdigit() for ch in s) == 5


def test_emoji_sequences_once(spark):
    s = "\U0001F44D\U0001F3FD \U0001F468‍\U0001F469‍\U0001F467 \U0001F1EB\U0001F1F7\U0001F1E9\U0001F1EA ❤️ 1️⃣ \U0001F600\U0001F600"
    assert one(spark, emoji_count, s) == 8


def test_every_code_point_with_the_emoji_property_counts(spark):
    import regex
    points = [c for c in [*range(0x20000), 0xE0067, 0xE007F] if not 0xD800 <= c < 0xE000 and c]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string")
    got = {r.c for r in df.select("c", emoji_count("t").alias("n")).filter("n > 0").collect()}
    want = {c for c in points if regex.match(r"\p{Emoji}", chr(c))} - set(map(ord, "0123456789#*")) \
        - set(range(0x1F1E6, 0x1F200))
    assert got == want
    assert {0xA9, 0x2122, 0x25B6, 0x23CF, 0x2B05, 0x3297} <= got and not {0x2713, 0x2606, 0x2717} & got


def test_emoji_sequence_types(spark):
    england = "\U0001F3F4" + "".join(chr(0xE0000 + ord(c)) for c in "gbeng") + "\U000E007F"
    for text, n in (("\u00a9 \u00a9\ufe0f", 2), ("\u25b6\ufe0e", 1), ("#\ufe0f\u20e3*\u20e3", 2), ("1 # *", 0),
                    (england, 1), (england + england, 2), ("\U0001F1E6", 0), ("\U0001F3FB", 1),
                    ("\U0001F9D1\U0001F3FD\u200d\U0001F91D\u200d\U0001F9D1\U0001F3FF", 1),
                    ("\U0001F3F3\ufe0f\u200d\U0001F308", 1), ("\u2713\u2606", 0)):
        assert one(spark, emoji_count, text) == n, text


def test_sentences(spark):
    assert one(spark, sentence_count, "Hi there. How are you?! I'm \"fine.\" ok") == 4
    assert one(spark, sentence_count, "") == 0
    assert one(spark, sentence_count, None) == 0


def test_words_and_chars(spark):
    assert one(spark, word_count, "I'm well-read, ok?") == 5   # I'm | well-read | , | ok | ?
    assert one(spark, char_count, "é😀") == 2                  # code points
    assert one(spark, url_count, "[URL] x [URL][URL]") == 3


def test_lexicon_tokens_match_python_w(spark):
    import re
    s = "Über-cool_x ÇA va? 123 naïve"
    got = spark.createDataFrame([(s,)], "t string").select(lexicon_tokens("t")).first()[0]
    assert got == re.findall(r"\w+", s.lower())


def test_stat_vector_order(spark):
    v = spark.createDataFrame([("A b. [URL] 12 😀",)], "t string").select(stat_vector("t")).first()[0]
    # sentences 2; tokens A b . [ URL ] 12 😀; 15 code points; 1 link, 1 emoji, 2 digits
    assert v == [2.0, 8.0, 15.0, 1.0, 1.0, 2.0]


def test_null_safe(spark):
    r = spark.createDataFrame([(None,)], "t string").select(
        word_count("t"), char_count("t"), digit_count("t"), F.size(lexicon_tokens("t"))).first()
    assert tuple(r) == (0, 0, 0, 0)
