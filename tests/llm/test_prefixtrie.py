import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from threadlens.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node, from whole sequences."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, tie, text))
    own = {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        sums[node] = (sum(sums[k][0] for k in kids[node]) or 1, saved + sum(sums[k][1] for k in kids[node]))
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(full[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(kids[node]),
                    *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df, **more):
    return sorted((tuple(r) for r in prefixtrie.trie(df, **more).collect()), key=str)


def some(n, seed, long=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, long))):
            rows.append((c, t, "user" if t % 2 else "assistant", f"é text {rng.integers(0, 2)}" if t < 3 else f"{c} {t}"))
    return rows


# a small sketch proves little, and classes split it: the result is the same
@pytest.mark.parametrize("cells", [1 << 4, 1 << 9, 1 << 23])
def test_against_brute_force(spark, cells):
    rows = some(150, 0)
    assert built(spark.createDataFrame(rows, SCHEMA), cells=cells) == brute(rows)


def test_long_and_copied_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SPREAD", 7)
    monkeypatch.setattr(prefixtrie, "PART", 3)
    rows = [(5, t, "user", f"turn {t}") for t in range(60)] + [(10, t, "user", f"turn {t}") for t in range(60)]
    rows += [(c, t, "user", f"turn {t}") for c in range(11, 40) for t in range(12)] + some(30, 2)
    assert built(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_hard_rows(spark):
    rows = [(None, 1, "user", "x"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 1, "a", "z"),
            (1, 3, "user", "ok"), (2, -5, "user", "ok"), (2, None, "user", "late"), (7, 1, "us", "erok"),
            (8, 1, "user", "ok"), (-3, 1, "user", "ok"), (-5, 1, "user", "ok"), (12, 0, "user", "w " * 50_000),
            (13, 0, "user", "w " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.selectExpr("*", "1 as pos", "2 as d", "3 as len", "4 as k1", "5 as base", "6 as n", "7 as h")
    assert built(extra) == brute(rows)
    assert built(df.filter("conv_id = 12")) == brute([r for r in rows if r[0] == 12])
    assert prefixtrie.trie(df.limit(0)).count() == 0


def test_sketch_never_estimates_too_little(spark):
    paths = spark.range(3000).selectExpr("xxhash64(id % 2000) as k1", "xxhash64(id % 2000, 1) as k2",
                                         "cast(null as long) as p1", "cast(null as long) as p2", "id % 2000 as i")
    for cells in (64, 1 << 13):
        rows = prefixtrie.screened(paths, prefixtrie.sketch(paths, cells), cells).collect()
        assert all(r.shared for r in rows if r.i < 1000)
    assert sum(r.shared for r in rows if r.i >= 1000) < 100  # and a wide one rarely too much
