"""The pipeline against plain versions of its stages, and on hard rows."""

import corpus_pipeline
import pytest
from conftest import SCHEMA, SF001
from pyspark.sql import functions as F
from test_covering import brute_components, brute_fingerprint
from test_secrets import SCANNER
from tokenizers import Tokenizer

from threadlens.llm import queries, secrets


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "secret_scan", "mix_sources", "bpe_encode"]
    known = stages["language_id"](spark, docs, SF001)
    assert known.columns == docs.columns
    assert known.count() == docs.count()  # all are prose in one of the four languages

    rows = sorted(known.collect(), key=lambda r: r.doc_id)
    group = brute_components([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows])
    one = stages["simhash_near_dedup"](spark, known, SF001)
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r, g in zip(rows, group) if r.doc_id == g)

    safe = stages["secret_scan"](spark, one, SF001)
    want = {r.doc_id: secrets.redacted(r.text, SCANNER.scan(r.text)[1]) for r in one.collect()}
    assert {r.doc_id: r.text for r in safe.collect()} == want
    assert safe.columns == docs.columns and all(r.n_chars == len(r.text) for r in safe.collect())

    mixed = stages["mix_sources"](spark, safe, SF001)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 2 and set(copies) <= set(want)

    tokens = Tokenizer.from_file(corpus_pipeline.vocabulary_path())
    last = stages["bpe_encode"](spark, mixed, SF001).collect()
    assert len(last) == sum(copies.values())
    for r in last:
        assert r.ids == tokens.encode(want[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF001)
    assert {"doc_id", "n_tokens", "ids"} <= set(got.columns) and got.count() > 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_hard_rows(spark, hard, clashing, empty, stage, tmp_path):
    name, run = stage
    for i, docs in enumerate((hard, clashing, empty, hard.withColumn("extra", F.create_map(F.lit(1), F.lit(2))))):
        out = run(spark, docs, SF001)
        if name != "bpe_encode":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")


def test_rejected_documents_go(spark):
    rows = [(i, "le chat est sur la table " * 9, "fr", "a", 1) for i in range(5)] + [(9, "0101 %%", "fr", "a", 1), (10, None, "fr", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.language_id(spark, docs, SF001)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
