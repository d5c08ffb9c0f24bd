import re

import numpy as np
import pytest
import xxhash
from conftest import SF001

from threadlens.llm import covering, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    fps, label = np.array(fps, np.uint64), np.array(ids)
    while True:
        new = np.array([label[np.bitwise_count(fps ^ f) <= 4].min() for f in fps])
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A B c D", "é É x y z é É x y z", "w " * 500])
def test_fingerprints(text):
    assert covering.fingerprint(text) == brute_fingerprint(text)


def test_every_pair_within_the_radius_meets_in_a_table():
    rng = np.random.default_rng(0)
    masks = [m % (1 << 64) for m in covering.masks(4)]
    assert len(masks) == 31 and len(set(masks)) == 31
    for _ in range(20_000):
        bits = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(not bits & m for m in masks)


@pytest.mark.parametrize("block", [1024, 8])
def test_chains_of_links(spark, block):
    rng = np.random.default_rng(1)
    fps = []
    for start in rng.integers(0, 2 ** 63, 40):
        at = int(start)
        for _ in range(int(rng.integers(1, 40))):
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                at ^= 1 << int(b)
            fps.append(at)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = df.join(covering.groups(df, block=block), "fp").orderBy("doc_id").collect()
    assert [r.component_id for r in got] == brute_components(range(len(fps)), fps)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op5_simhash(spark, SF001).orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in got] == brute_components([r.doc_id for r in docs], fps)


def test_hard_rows(clashing, empty, spark):
    got = covering.near_duplicates(clashing.select("doc_id", "text")).collect()
    assert len(got) == clashing.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[9].component_id == by_id[1].component_id == 1
    assert by_id[3].component_id == by_id[4].component_id == by_id[5].component_id == 3
    assert by_id[3].fingerprint == "0" * 16
    assert all(r.component_id in (1, 3) for r in got if r.doc_id is None)
    one = covering.keep_one(clashing)
    assert one.columns == clashing.columns
    ids = sorted(r.doc_id for r in one.collect())
    assert ids == sorted({r.component_id for r in got})
    assert covering.keep_one(empty).count() == 0
    only_null = spark.createDataFrame([(None, "q w e r t y"), (None, "q w e r t y")], "doc_id long, text string")
    assert [r.component_id for r in covering.near_duplicates(only_null).collect()] == [None, None]
    assert covering.keep_one(only_null).count() == 1
