import re

import numpy as np
import pytest
from conftest import SF001

from threadlens.llm import queries, tensored

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    label = [(i is None, i or 0) for i, _ in rows]
    own = list(label)
    near = [[b for b in range(len(rows)) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])] for a in range(len(rows))]
    while True:
        new = [min([own[a], *(label[b] for b in near[a])]) if a in near[a] else own[a] for a in range(len(rows))]
        new = [min(x, y) for x, y in zip(new, label)]
        if new == label:
            break
        label = new
    names = [None if n else i for n, i in label]
    return sorted(((i, len(s), c, i is not None and i == c) for (i, _), s, c in zip(rows, sets, names)), key=str)


def found(df, **more):
    return sorted((tuple(r) for r in tensored.near_duplicates(df, **more).collect()), key=str)


def families(n, size, seed, edits=6, words=120):
    """Documents in families of edited copies, all with one passage in common."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for f in range(n):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(int(rng.integers(1, size))):
            own = list(base)
            for at in rng.integers(0, words, int(rng.integers(0, edits))):
                own[at] = f"x{rng.integers(0, 10 ** 6)}"
            rows.append((len(rows), " ".join(own + passage)))
    return rows


# small blocks: prefix filtering and pairs of blocks take part
@pytest.mark.parametrize("block", [512, 8])
def test_against_brute_force(spark, block):
    rows = families(30, 14, 0)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), block=block) == brute(rows)


def test_one_large_family(spark):
    rows = families(1, 260, 3, edits=9)[:250]
    rows = rows or families(1, 260, 4, edits=9)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), block=32) == brute(rows)


def test_joined_entries_keep_all_links(monkeypatch, spark):
    rows = families(20, 12, 5)
    monkeypatch.setattr(tensored, "_SETS", 10)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_recall_of_the_tables():
    """Pairs at the threshold meet in a table."""
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(2000):
        items = rng.integers(0, 2 ** 63, 100).astype(np.uint64)
        a, b = tensored.bands(items[:90]), tensored.bands(items[10:])  # 80 of 100
        same = a == b
        missed += not (same[:tensored.SIDE].any() and same[tensored.SIDE:].any())
    assert missed <= 1


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in queries.op13_tensored(spark, SF001).collect()), key=str)
    assert got == brute([tuple(r) for r in docs])


def test_hard_rows(spark, hard_rows, clashing, empty):
    rows = [r[:2] for r in hard_rows] + [(1, "one two three"), (20, "ONE\ttwo three"), (21, "one two")]
    more = clashing.unionByName(spark.createDataFrame(rows[-3:], "doc_id long, text string"), allowMissingColumns=True)
    more = more.selectExpr("*", "1 as h1", "2 as h2", "3 as n", "4 as items", "5 as first", "6 as bands", "7 as codes")
    assert found(more) == brute(rows)
    assert tensored.near_duplicates(empty).count() == 0
