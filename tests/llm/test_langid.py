import math

import numpy as np
import pytest
from conftest import SF01

from threadlens.llm import langid, queries


def brute_length(counts, lang, word):
    """Code length of one word by dictionaries of contexts."""
    trees = {}
    for name, w, n in counts:
        if name == lang:
            data = b" " + w.encode() + b" "
            for at in range(1, len(data)):
                for order in range(min(at, langid.ORDER) + 1):
                    node = trees.setdefault(data[at - order:at], {})
                    node[data[at]] = node.get(data[at], 0) + n
    total, data = 0.0, b" " + word.encode() + b" "
    for at in range(1, len(data)):
        bits = None
        cost = 0.0
        for order in range(min(at, langid.ORDER), -1, -1):
            node = trees.get(data[at - order:at])
            if not node:
                continue
            n, d = sum(node.values()), len(node)
            if data[at] in node:
                bits = cost + math.log2((n + d) / node[data[at]])
                break
            cost += math.log2((n + d) / d)
        total += cost + 8 if bits is None else bits
    return total


COUNTS = [("a", "abra", 3), ("a", "cadabra", 2), ("a", "bar", 1), ("b", "über", 4), ("b", "bar", 2), ("b", "rab", 5)]


def test_code_lengths_equal_those_of_plain_context_trees():
    trees = langid.ContextTrees.fit(COUNTS)
    words = ["abra", "bar", "rabbar", "überabra", "zzz", "é"]
    got = trees.code_lengths(words)
    want = [[brute_length(COUNTS, lang, w) for lang in ("a", "b")] for w in words]
    assert np.allclose(got, want, atol=1e-3)


def test_a_texts_length_is_the_sum_over_its_words_whatever_the_cache_holds():
    trees = langid.ContextTrees.fit(COUNTS)
    texts = ["abra bar", "Bar, abra! " * 50, "rab" * 40]
    once = langid.Scorer(trees).predict(texts)
    scorer = langid.Scorer(trees)
    for text, (lang, score, rate) in zip(texts, once):
        again = scorer.predict([text])[0]
        assert again[0] == lang and again[1:] == pytest.approx((score, rate))


def test_no_letters_no_labels():
    trees = langid.ContextTrees.fit(COUNTS)
    for text in (None, "", " ", "123 ½ ²"):
        assert langid.Scorer(trees).predict([text])[0][:2] == ("und", 0.0)
    assert langid.Scorer(langid.ContextTrees.fit([])).predict(["text"])[0][:2] == ("und", 0.0)


def test_hard_rows(hard, clashing, empty):
    trees = langid.fit(hard)
    assert trees.languages == ["en", "fr"]
    got = langid.predict(clashing, trees, keep=("doc_id",)).collect()
    assert len(got) == hard.count()
    by_id = {r.row.doc_id: r for r in got}
    assert by_id[8].lang_pred == "fr" and by_id[4].lang_pred == by_id[3].lang_pred == by_id[6].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identified(clashing).columns == clashing.columns
    assert langid.fit(empty).languages == [] and langid.identified(empty).count() == 0


def test_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, SF01)
    truth = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert got.count() == 1000


def test_copies_of_a_text_are_drawn_one_by_one(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "'en' AS lang", "if(id < 2000, 'the same text', concat('text ', id)) AS text")
    drawn = langid.sample(rows, bound=600)
    copies = drawn.filter("text = 'the same text'").count()
    assert 120 < copies < 280 and 480 < drawn.count() < 720
    assert langid.sample(rows.drop("doc_id"), bound=600).count() < 6000  # without an id, by the text


@pytest.mark.parametrize("text", ["abra bar", "über bar é", "日本 语言 über", "рус " * 9])
def test_the_rate_is_by_encoded_byte(text):
    scorer = langid.Scorer(langid.ContextTrees.fit(COUNTS))
    for texts in ([text], ["bar", text, "rab" * 40], [text]):
        bits, size = scorer.totals(texts)
        assert size.tolist() == [sum(len(w.encode()) + 1 for w in t.split()) for t in texts]
    assert scorer.predict([text])[0][2] == pytest.approx(bits.min() / size[0])
