import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import SF001

from threadlens.llm import queries, rlindex, suffixtree, windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, unit):
    units = [WORD.findall((t or "").encode()) if unit == "words" else (t or "").encode() for _, t in rows]
    key = (lambda u: b" ".join(u)) if unit == "words" else (lambda u: u)
    first = {}
    for (doc, _), u in zip(rows, units):
        for i in range(len(u) - 49) if doc is not None else ():
            k = key(u[i:i + 50])
            first[k] = min(doc, first.get(k, doc))
    out = []
    for (doc, _), u in zip(rows, units):
        covered = np.zeros(len(u), bool)
        for i in range(len(u) - 49) if doc is not None else ():
            if first[key(u[i:i + 50])] < doc:
                covered[i:i + 50] = True
        if unit == "words":
            kept = b" ".join(x for x, c in zip(u, covered) if not c)
            out.append((doc, len(u), int(covered.sum()), hashlib.sha256(kept).hexdigest()))
        else:
            kept = bytes(np.frombuffer(u, np.uint8)[~covered])
            spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
            out.append((doc, len(u), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


OPERATORS = {"words": suffixtree, "bytes": rlindex}


def made_rows():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(30)]

    def text(n):
        return " ".join(rng.choice(vocabulary, n))

    passages, rows = [text(60) for _ in range(4)], []
    for i in range(60):
        parts = [text(int(rng.integers(0, 120))) for _ in range(3)]
        for p in passages:
            if rng.random() < 0.4:
                parts.insert(int(rng.integers(0, len(parts))), p)
        rows.append((int(rng.integers(0, 45)), ("\n" if i % 2 else " ").join(parts)))
    return rows + [(None, passages[0]), (None, None), (7, None), (8, ""), (100, "a " * 3000), (101, "a " * 200),
                   (102, "x" * 400), (103, "yx" + "x" * 300), rows[3], rows[3], (104, "é" * 70 + passages[1]),
                   (105, "\x00" * 120), (106, "\x00" * 60 + "q")]


@pytest.mark.parametrize("unit", ["words", "bytes"])
@pytest.mark.parametrize("limits", [{}, {"hot": 1, "group_bytes": 5000}])
def test_made_rows(spark, unit, limits, monkeypatch):
    operator, rows = OPERATORS[unit], made_rows()
    monkeypatch.setattr(operator, "removed", lambda *a: windows.removed(*a, **limits))
    if limits:
        monkeypatch.setattr(windows, "INDEX_BYTES", 500)
    got = operator.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, unit)


@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_a_key_whose_later_rows_are_all_copies(spark, unit, monkeypatch):
    """Marks are told while a key's rows are still coming; no row after that may be a segment's first."""
    monkeypatch.setattr(windows, "INDEX_ROWS", 2)
    monkeypatch.setattr(windows, "PLACES", 3)
    operator, symbol = OPERATORS[unit], "x " if unit == "words" else "x"
    monkeypatch.setattr(operator, "removed", lambda *a: windows.removed(*a, group_bytes=500))
    rows = [(i, symbol * (49 + windows.MOST * (4 + i))) for i in range(30)]
    got = operator.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, unit)


@pytest.mark.parametrize("unit", ["words", "bytes"])
@pytest.mark.parametrize("alphabet", [1, 2, 3])
def test_segments_of_one_key_are_indexed_in_pieces(unit, alphabet, monkeypatch):
    rng = np.random.default_rng(6)
    kind, mark = (windows.Words, suffixtree.mark) if unit == "words" else (windows.Bytes, rlindex.mark)
    segments = {}
    for _ in range(400):
        symbols = [b"x"] * int(rng.integers(0, 80)) + [b"abc"[i:i + 1] for i in rng.integers(0, alphabet, 111)]
        symbols = symbols[:int(rng.integers(50, 112))]
        segments[(b" " if unit == "words" else b"").join(symbols)] = symbols
    n, first = np.array([len(x) - 49 for x in segments.values()]), rng.integers(0, 50, len(segments))
    least = {}
    for x, doc in zip(segments.values(), first.tolist()):
        for i in range(len(x) - 49):
            least[tuple(x[i:i + 50])] = min(doc, least.get(tuple(x[i:i + 50]), doc))
    monkeypatch.setattr(windows, "INDEX_BYTES", 1000)
    sizes = []

    def measured(payloads, n, first):
        sizes.append(sum(map(len, payloads)))
        return mark(payloads, n, first)

    got = windows.in_pieces(measured, kind(), list(segments), n, first)
    assert got.tolist() == [least[tuple(x[i:i + 50])] for x in segments.values() for i in range(len(x) - 49)]
    assert max(sizes) < 0.5 * sum(map(len, segments)) or alphabet == 1


def test_a_bundle_indexes_a_large_key_in_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(windows, "INDEX_BYTES", 1000)
    sizes = []

    def measured(payloads, n, first):
        sizes.append(sum(map(len, payloads)))
        return rlindex.mark(payloads, n, first)

    bundle = windows.Bundle(measured, windows.Bytes, 2)
    for doc in range(500):
        around = rng.integers(97, 123, 60).astype(np.uint8).tobytes()
        bundle.add(1, around[:30] + b"one gram of all rows" + around[30:], 31, doc, doc, 0)
    *_, bits = bundle.marks()
    assert not bits.any() and len(sizes) > 1 and max(sizes) <= 3000


@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_rows_whose_hashes_agree_are_not_mixed_up(spark, unit, monkeypatch):
    monkeypatch.setattr(windows, "row_hash", lambda doc_id, text: F.pmod(F.col(doc_id), F.lit(3)).cast("long"))
    rows = sorted({r[0]: r for r in made_rows() if r[0] is not None}.values())
    got = OPERATORS[unit].dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, unit)


@pytest.mark.parametrize("unit,query", [("words", queries.op7_suffix_tree), ("bytes", queries.op8_run_length_index)])
def test_whole_table(spark, unit, query):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert sorted(map(tuple, query(spark, SF001).collect()), key=repr) == brute(rows, unit)


@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_hard_rows(hard_rows, clashing, empty, unit):
    got = OPERATORS[unit].dedup(clashing)
    rows = [(r[0], r[1]) for r in hard_rows]
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=repr) == brute(rows, unit)
    for r in got.collect():
        kept = r.kept.encode() if unit == "words" else bytes(r.kept)
        assert hashlib.sha256(kept).hexdigest() == r.kept_sha256
    assert OPERATORS[unit].dedup(empty).count() == 0


def test_leaves_and_common_prefixes():
    rng = np.random.default_rng(2)
    sequence = np.concatenate([rng.integers(0, 2, 300), -np.arange(1, 60)])
    starts = np.arange(300)
    order, common = suffixtree.leaves(sequence, starts, depth=50)
    text = sequence.tolist()
    prefixes = [text[i:i + 50] for i in order]
    ranked = {v: i for i, v in enumerate(sorted(set(text)))}
    assert [[ranked[x] for x in p] for p in prefixes] == sorted([ranked[x] for x in text[i:i + 50]] for i in starts)
    for a, b, c in zip(prefixes, prefixes[1:], common):
        want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert c == want


def test_run_length_index_samples_few_positions_and_tells_all():
    rng = np.random.default_rng(3)
    unit = rng.integers(97, 101, 40).astype(np.uint8).tobytes()
    payloads = [unit * 20, unit * 15 + b"x", b"y" + unit * 18, b"\x00" * 30]
    size = np.array([len(p) + 1 for p in payloads])
    end = np.cumsum(size)
    symbols = np.frombuffer(b"\0".join(payloads) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[end - 1] = 0
    segment = np.repeat(np.arange(4), size)
    left = end[segment] - np.arange(len(symbols))
    is_start = np.zeros(len(symbols), bool)
    is_start[end - size] = True
    index = rlindex.RunLengthIndex(symbols, left, is_start)
    assert index.runs < 0.2 * index.size
    suffix = [symbols[i:i + left[i]].tolist() for i in range(len(symbols))]
    order = sorted(range(len(symbols)), key=lambda i: (suffix[i], i))
    previous, match = index.statistics()
    for a, b in zip(order, order[1:]):
        common = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y or x == 0), 0)
        assert previous[b] == a and match[b] == common


@pytest.mark.parametrize("length,gram", [(50, 20), (50, 8), (7, 3), (5, 5)])
def test_segments_cover_every_window_once_and_equal_windows_share_a_gram(length, gram):
    rng = np.random.default_rng(4)
    symbols = np.concatenate([rng.integers(0, 3, 400), np.zeros(300, np.int64)]).astype(np.uint64)
    grams, seen = {}, []
    for h, lo, n in windows.segments(symbols, gram, length):
        for x, i, m in zip(h, lo, n):
            assert 1 <= m <= windows.MOST
            for w in range(i, i + m):
                seen.append(w)
                assert grams.setdefault(tuple(symbols[w:w + length]), x) == x
    assert seen == list(range(len(symbols) - length + 1))


def test_longer_grams_are_prefixes_that_equal_windows_share():
    rng = np.random.default_rng(5)
    symbols = np.concatenate([rng.integers(0, 2, 500), np.zeros(200, np.int64)]).astype(np.uint64)
    known, seen = {}, []
    for h, lo, n in windows.segments(symbols, 8, 50, (16, 32)):
        for x, i, m in zip(h, lo, n):
            for w in range(i, i + m):
                seen.append(w)
                window = symbols[w:w + 50].tolist()
                assert known.setdefault(tuple(window), tuple(x)) == tuple(x)
                runs = [windows.rolling(symbols[w:w + 50], k) for k in (8, 16, 32)]
                at = int(np.argmin(runs[0][:19]))
                assert tuple(x) == tuple(r[at] for r in runs)
    assert seen == list(range(651))


def test_the_key_is_the_shortest_prefix_that_is_not_hot():
    grams = np.array([[1, 2, 3], [4, 2, 3], [1, 5, 3], [1, 2, 6], [7, 8, 9]], np.uint64)
    hot, shared = np.array([1, 2, 3], np.uint64), np.array([1, 2, 3, 4, 6], np.uint64)
    level, take = windows.keys_of(grams, shared, hot)
    assert level.tolist() == [3, 0, 1, 2, 0] and take.tolist() == [True, True, False, True, False]


def test_most_removed_words_are_found_by_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame(made_rows(), "doc_id long, text string")

    def words_removed():
        return suffixtree.dedup(docs, with_text=False).groupBy().sum("n_removed").first()[0]

    whole = words_removed()
    monkeypatch.setattr(suffixtree, "mark", lambda payloads, n, first: np.full(n.sum(), np.iinfo(np.int64).max))
    assert words_removed() < 0.2 * whole
