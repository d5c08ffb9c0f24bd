"""Scaler fixtures and encoding properties."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators.encode import CLS, PAD, SEP, UNK, encode, pad, vocabulary
from threadlens.operators.scaling import ScalerModel, fit_scaler


def test_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, c double")
    m = ScalerModel.from_df(fit_scaler(df, {"a": "a", "c": "c"}))
    assert m.scale[0] == pytest.approx(1.2472191, rel=1e-6)
    assert m.scale[1] == 1.0                       # constant: only centred
    z = m.transform(df).agg(F.avg("a"), F.stddev_pop("a"), F.max("c")).first()
    assert z[0] == pytest.approx(0.0, abs=1e-12) and z[1] == pytest.approx(1.0)
    assert z[2] == 0.0


def test_encode_truncate_pad_mask(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a zzz"), (3, ""), (4, " ".join(["a"] * 600))],
                                 "id long, t string")
    voc = vocabulary(docs, "t", 2)                 # "a" then "b" (tie b/c broken by token)
    ids = {r.token: r.id for r in voc.collect()}
    assert ids == {"a": 4, "b": 5}
    e = {r.id: r for r in encode(docs, ["id"], "t", voc, max_len=8).collect()}
    assert e[1].input_ids == [CLS, 4, 5, 4, UNK, SEP]
    assert e[3].input_ids == [CLS, SEP]
    assert len(e[4].input_ids) == 8 and e[4].n_tokens == 600   # whole text counted
    p = pad(encode(docs, ["id"], "t", voc, max_len=8).withColumn("g", F.lit(1)), ["g"], max_groups=1).collect()
    for r in p:
        assert len(r.input_ids) == 8 and len(r.attention_mask) == 8
        n = sum(r.attention_mask)
        assert all(x == PAD for x in r.input_ids[n:])


def test_assemble_samples_record(spark):
    from threadlens.operators.lexicon import lexicon_from_pairs
    from threadlens.operators.samples import assemble_samples
    from threadlens.operators.scaling import ScalerModel, fit_array_scaler
    texts = spark.createDataFrame([(1, "train", "the rest of it."), (2, "train", "re re"), (3, "test", "")],
                                  "id long, split string, c string")
    lex = lexicon_from_pairs(spark, [("th*", "c1"), ("re*", "c2")], ["c1", "c2"])
    voc = vocabulary(texts, "c", 10)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "id long, label int")
    s = {r.id: r for r in assemble_samples(texts, "id", "c", lex, voc, 10, split_col="split",
                                           labels=labels, pad_groups=2).collect()}
    assert set(s) == {1, 2} and s[1].label == 1
    assert s[1].lex_vec == [1.0, 1.0] and s[2].lex_vec == [0.0, 2.0]
    assert s[1].stat_vec[2] == 15.0                    # characters
    assert len(s[1].content.input_ids) == len(s[2].content.input_ids)   # padded per split
    un = assemble_samples(texts, "id", "c", lex, voc, 10, labels=labels, labelled=False).collect()
    assert [r.id for r in un] == [3] and "label" not in un[0].asDict()
    raw = assemble_samples(texts, "id", "c", lex, voc, 10)
    m = ScalerModel.from_df(fit_array_scaler(raw, "lex_vec", ["c1", "c2"]))
    z = assemble_samples(texts, "id", "c", lex, voc, 10, lex_scaler=m).agg(
        F.avg(F.element_at("lex_vec", 2))).first()[0]
    assert z == pytest.approx(0.0, abs=1e-12)
