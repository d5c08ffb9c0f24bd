"""MinHash near-duplicates by tensored banding.

A document is the set of its distinct shingles, each a 64-bit hash. Two collections of
``SIDE`` bands, of ``WIDTH`` minhashes each, are computed, and every pair of a band of the
first and a band of the second is a table: SIDE^2 tables of 2 * WIDTH minhashes a key from
only 2 * SIDE * WIDTH minhashes, where plain banding needs SIDE^2 * 2 * WIDTH. A pair of
similarity s meets in no table with a chance of about 2 * (1 - s^WIDTH)^SIDE at most: 5e-6
at 0.8 with the defaults, and less above.

Only distinct sets enter the tables. A set is dealt out once for each band of the first
collection and carries its bands of the second, so that the keys of SIDE tables are formed
where it arrives. Sets that share a key there are joined to one candidate group; a joined
group goes on as one row with all its keys, before the shuffle too, so that a key which
very many sets share stays small.

Candidate groups are then compared on full sets, in blocks of about ``BLOCK``. Each
comparison counts all intersections by matrix products and sends on a spanning forest of
its links. Groups of several blocks go on: a few sets of each component found meet, until
that joins no more. Then prefix filtering, which is exact, tells which
components may still be linked: sets of similarity t or more share one of the first
n - ceil(t * n) + 1 shingles in any common order, here with the most frequent ones last, so
that a passage in very many documents joins none of them. In what that joins, the sets
outside the largest component meet all others, in pairs of blocks.

Defined results: documents without words, null texts included, have an empty set and are
linked with nothing; rows with a null id are linked but name no component; rows that
repeat an id are documents of their own, with that id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save
from .prefixtrie import TABLES, _places, sketch

SHINGLE = 4
PERCENT = 80
SIDE, WIDTH = 18, 3
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
HOT_SHINGLES = 10_000
LEADERS = 4
FILTER_CELLS = 1 << 23
TASK_ROWS = 20_000
_SETS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the six separators
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length) + np.arange(len(words))
    start = end - length
    start, end = (start[:len(words) - size + 1], end[size - 1:]) if len(words) >= size else (start[:1], end[-1:])
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(start.tolist(), end.tolist())),
                                 np.uint64, len(start)))


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def bands(hashes: np.ndarray, side: int = SIDE, width: int = WIDTH) -> np.ndarray:
    """The 2 * side bands of a set, each the combined ``width`` minhashes."""
    n = 2 * side * width
    seeds = _stir(np.arange(1, n + 1, dtype=np.uint64) * _MIX)[:, None]
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 4096):
        least = np.minimum(least, _stir(hashes[None, lo:lo + 4096] ^ seeds).min(axis=1))
    out = np.arange(2 * side, dtype=np.uint64)
    for m in least.reshape(2 * side, width).T:
        out = _stir(out + m)
    return out


def described(docs: DataFrame, size: int = SHINGLE, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """doc_id, n, (h1, h2) and the bands of every row of (doc_id, text); null digests for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, b = [], [], [], []
            for text in batch["text"]:
                found = shingles(text.as_py(), size)
                d = set_digest(found) if len(found) else (None, None)
                n.append(len(found))
                h1.append(d[0])
                h2.append(d[1])
                b.append(bands(found, side, width).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(b, pa.binary())], ["doc_id", "n", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands binary")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' component, links (i, j)."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


_ENTRY = ["key", "h1", "h2", "codes", "o1", "o2"]
_ENTRIES = "key long, h1 long, h2 long, codes binary, o1 long, o2 long"


def _decode(codes: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of entries: one set's bands as 16-bit numbers, or a joined group's (band, number) codes."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    single = np.flatnonzero(sizes == 2 * side)
    flat = np.frombuffer(b"".join(codes[i] for i in single), np.uint16).reshape(-1, side)
    code = (flat.astype(np.int64) + (np.arange(side) << 16)).reshape(-1)
    rows = [np.repeat(single, side)]
    parts = [code]
    for i in np.flatnonzero(sizes != 2 * side).tolist():
        own = np.frombuffer(codes[i], np.uint32)[1:].astype(np.int64)  # after a mark
        rows.append(np.full(len(own), i))
        parts.append(own)
    return np.concatenate(rows), np.concatenate(parts)


def _join(key: np.ndarray, h1: np.ndarray, h2: np.ndarray, codes: list[bytes], side: int):
    """Entries joined where they share a key and a code: (kept places, their codes), (places, their leaders)."""
    order = np.lexsort((h2, h1, key))
    key, h1, h2, codes = key[order], h1[order], h2[order], [codes[i] for i in order.tolist()]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    many = np.flatnonzero((np.bincount(group) > 1)[group]) if len(key) else np.zeros(0, np.int64)
    keep, kept_codes, moved, leader = np.ones(len(key), bool), {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(many):
        row, code = _decode([codes[i] for i in many.tolist()], side)
        # one number a (group, code); side * 2^16 codes a group
        at = group[many][row] * (side << 16) + code
        by = np.lexsort((row, at))
        same = np.flatnonzero(at[by][1:] == at[by][:-1])
        label = _roots(len(many), row[by[same]], row[by[same + 1]])
        moved = np.flatnonzero(label != np.arange(len(many)))
        leader = label[moved]
        for one in np.unique(leader).tolist():
            held = np.unique(code[np.isin(row, np.flatnonzero(label == one))]) if len(many) < 64 else None
            kept_codes[one] = held
        if any(v is None for v in kept_codes.values()):
            pairs = np.unique(np.stack([label[row], code], axis=1), axis=0)
            cut = np.searchsorted(pairs[:, 0], list(kept_codes))
            end = np.searchsorted(pairs[:, 0], list(kept_codes), side="right")
            kept_codes = {one: pairs[a:b, 1] for one, a, b in zip(kept_codes, cut.tolist(), end.tolist())}
        kept_codes = {int(many[one]): np.concatenate([[0], held]).astype(np.uint32).tobytes()
                      for one, held in kept_codes.items()}
        moved, leader = many[moved], many[leader]
        keep[moved] = False
    kept = np.flatnonzero(keep)
    return (key, h1, h2), (kept, [kept_codes.get(i, codes[i]) for i in kept.tolist()]), (moved, leader)


def _rows(key, h1, h2, codes, o1, o2) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
         pa.array(codes, pa.binary()) if codes is not None else pa.nulls(n, pa.binary()),
         pa.array(o1, pa.int64()) if o1 is not None else pa.nulls(n, pa.int64()),
         pa.array(o2, pa.int64()) if o2 is not None else pa.nulls(n, pa.int64())], _ENTRY)


def candidates(nodes: DataFrame, side: int = SIDE) -> DataFrame:
    """Links (u, v) of digests as structs; sets that meet in a table are in one component of them."""
    def links_of(arrays, joined) -> pa.RecordBatch:
        (_, h1, h2), (moved, leader) = arrays, joined
        return _rows(h1[moved], h1[moved], h2[moved], None, h1[leader], h2[leader])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            h1, h2 = table["h1"].to_numpy(), table["h2"].to_numpy()
            b = np.frombuffer(b"".join(table["bands"].to_pylist()), np.uint64).reshape(-1, 2 * side)
            second = [x.tobytes() for x in (b[:, side:] >> np.uint64(48)).astype(np.uint16)]
            for t in range(side):  # a table of the first collection at a time
                arrays, (kept, codes), joined = _join(b[:, t].view(np.int64), h1, h2, second, side)
                key, a1, a2 = arrays
                for lo in range(0, len(kept), 5000):
                    at = kept[lo:lo + 5000]
                    yield _rows(key[at], a1[at], a2[at], codes[lo:lo + 5000], None, None)
                yield links_of(arrays, joined)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _SETS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h1, h2, codes = (np.zeros(0, np.int64),) * 3 + ([],)
        for batch in batches:
            linked = batch["codes"].is_null().to_numpy(zero_copy_only=False)
            if linked.any():
                yield batch.filter(pa.array(linked))
            new = batch.filter(pa.array(~linked))
            key, h1, h2 = (np.concatenate([x, new[c].to_numpy()]) for x, c in ((key, "key"), (h1, "h1"), (h2, "h2")))
            codes = codes + new["codes"].to_pylist()
            if len(key) >= 5000:
                arrays, (kept, own), joined = _join(key, h1, h2, codes, side)
                yield links_of(arrays, joined)
                # the last key may go on: its joined entries stay
                last = np.flatnonzero(arrays[0][kept] == arrays[0][-1])
                key, h1, h2 = (x[kept[last]] for x in arrays)
                codes = [own[i] for i in last.tolist()]
        if len(key):
            arrays, _, joined = _join(key, h1, h2, codes, side)
            yield links_of(arrays, joined)

    met = nodes.select("h1", "h2", "bands").mapInArrow(deal, _ENTRIES) \
        .repartition("key").sortWithinPartitions("key").mapInArrow(gather, _ENTRIES)
    return met.select(F.struct("h1", "h2").alias("u"),
                      F.struct(F.col("o1").alias("h1"), F.col("o2").alias("h2")).alias("v"))


def _marks(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What stands for a doc_id in the filter of rows to compare."""
    own = ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return _stir(own + _MIX).view(np.int64), _stir(own ^ _MIX).view(np.int64)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(h1, h2, items) of the rows whose digest and doc_id are those of ``wanted`` (h1, h2, first, ...), with its columns.

    A filter of bounded size on the doc_id keeps most other rows from being cut into shingles and shuffled.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = _marks(batch["first"])
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2)], ["k1", "k2"])

    n = wanted.count()
    cells = min(FILTER_CELLS, 1 << max(4, (4 * n).bit_length()))
    held = docs.sparkSession.sparkContext.broadcast(
        sketch(wanted.select("first").mapInArrow(mark, "k1 long, k2 long"), cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.ones(batch.num_rows, bool)
            for t, at in enumerate(_places(*_marks(batch["doc_id"]), cells)):
                at = at + t * cells
                known &= (held.value[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3) > 0
            batch = batch.filter(pa.array(known))
            sets = [shingles(t.as_py(), size) for t in batch["text"]]
            digests = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[:, 0]), pa.array(digests[:, 1]), batch["doc_id"],
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "doc_id", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "h1 long, h2 long, doc_id long, items binary")
    mine = wanted.withColumnsRenamed({"h1": "w1", "h2": "w2"})
    return rows.join(mine, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))
                     & F.col("doc_id").eqNullSafe(F.col("first"))).drop("w1", "w2", "doc_id", "first")


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (i, j) among the sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size.astype(np.int64))
    shared = times[column] > 1  # the others add nothing to an intersection
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n))
    for lo in range(0, int((times > 1).sum()), 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        has = np.zeros((n, int(column[b - 1]) - lo + 1), np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        both += has @ has.T
    return np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))


def compared(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) of the components (``label``) that full sets within each (root, a, b) link: each to the least one.

    ``rows`` has h1, h2, items, root, a, b and label.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        current = None

        def flush() -> pa.RecordBatch:
            names = sorted({label for _, label in held.values()})
            number = {label: i for i, label in enumerate(names)}
            at = np.array([number[label] for _, label in held.values()])
            u = v = np.zeros(0, np.int64)
            if len(names) > 1:
                i, j = linked([np.frombuffer(items, np.uint64) for items, _ in held.values()], percent)
                least = _roots(len(names), at[i], at[j])
                u = np.flatnonzero(least != np.arange(len(names)))
                v = least[u]
            return pa.RecordBatch.from_arrays(
                [pa.array([names[x][k] for x in side.tolist()], pa.int64()) for side in (u, v) for k in (0, 1)],
                ["u1", "u2", "v1", "v2"])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("root", "a", "b", "h1", "h2", "items", "label")]
            for root, a, b, h1, h2, items, label in zip(*columns):
                group = (root["h1"], root["h2"], a, b)
                if group != current:
                    if len(held) > 1:
                        yield flush()
                    held, current = {}, group
                held[h1, h2] = (items, (label["h1"], label["h2"]))
        if len(held) > 1:
            yield flush()

    rows = rows.select("root", "a", "b", "h1", "h2", "items", "label") \
        .repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    return rows.mapInArrow(run, "u1 long, u2 long, v1 long, v2 long") \
        .select(F.struct(F.col("u1").alias("h1"), F.col("u2").alias("h2")).alias("u"),
                F.struct(F.col("v1").alias("h1"), F.col("v2").alias("h2")).alias("v"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """At most one partition for every ``TASK_ROWS`` rows, so that small tables are not written as many tiny files."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): alternating stars, two shuffles by node a round."""
    edges = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    n = edges.count()
    edges = sized(edges, n)
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    while True:
        # a node's larger neighbours link to the least of its neighbourhood
        both = edges.select(ways.alias("e")).select("e.*").repartition("u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u") \
            .select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        # a node and its smaller neighbours link to the least of them; no more edges than before
        large = large.repartition("u").groupBy("u", "v").agg(F.max("moved").alias("moved"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        is_least = F.col("v") == F.col("m")
        small = small.select(F.when(is_least, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"),
                             (F.col("moved") | ~is_least).alias("moved"))
        edges = save(sized(small, n))
        if edges.filter("moved").isEmpty():  # stars already: each node has its root
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def blocked(groups: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows (h1, h2, n, first, root) of groups of two or more, with their group's ``blocks`` and their own block."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("items")).filter("sets > 1") \
        .select("root", F.greatest(F.ceil(F.col("sets") / block), F.ceil(F.col("items") / block_shingles))
                .cast("int").alias("blocks"))
    return groups.join(sizes, "root") \
        .withColumn("mine", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))


def by_prefix(sets: DataFrame, percent: int = PERCENT, many: int = BLOCK, hot: int = HOT_SHINGLES) -> DataFrame:
    """Links (u, v) between the components (``label``) of sets (items, label) that share a shingle of their prefixes."""
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(batch["items"].to_pylist()), np.int64))], ["item"])

    # the frequent ones last: at most ``hot`` of them, which is enough for passages that very many documents share
    often = sets.select("items").mapInArrow(items, "item long").groupBy("item").count().filter(F.col("count") > many) \
        .orderBy(F.desc("count"), "item").limit(hot).collect()
    rank = {r.item: i for i, r in enumerate(reversed(often), 1)}
    known = np.array(sorted(rank), np.int64)
    place = np.array([rank[i] for i in known.tolist()], np.int64)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for one in batch["items"].to_pylist():
                own = np.frombuffer(one, np.int64)
                last = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    last = np.where(known[at] == own, place[at], 0)
                found.append(own[np.lexsort((own, last))][:len(own) - -(-percent * len(own) // 100) + 1])
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            labels = batch["label"].take(of)
            yield pa.RecordBatch.from_arrays(
                [labels.field("h1"), labels.field("h2"), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))],
                ["h1", "h2", "item"])

    keys = save(sets.mapInArrow(prefix, "h1 long, h2 long, item long")
                .select(F.struct("h1", "h2").alias("u"), "item").distinct())
    least = keys.groupBy("item").agg(F.min("u").alias("v"), F.max("u").alias("w")).filter("v <> w").drop("w")
    return keys.join(least, "item").select("u", "v")


def _links(docs: DataFrame, nodes: DataFrame, size: int, percent: int, block: int, side: int) -> DataFrame:
    """(h1, h2, root) of every set that may be linked with another; sets of one root are linked, on full sets."""
    coarse = components(candidates(nodes, side)).select("node.h1", "node.h2", "root")
    placed = save(blocked(nodes.select("h1", "h2", "n", "first").join(coarse, ["h1", "h2"]), block))
    n_placed = placed.count()

    def joined(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows with the components that the links, one of each component at most, join theirs to."""
        rows = rows.join(links.select(F.col("u").alias("label"), "v"), "label", "left")
        return save(sized(rows.withColumn("label", F.coalesce("v", "label")).drop("v"), n_placed))

    # each set is in one block, and has the component that its block gives it
    one = F.lit(0).alias("b")
    placed = placed.withColumn("label", F.struct("h1", "h2"))
    asked = placed.select("h1", "h2", "first", "root", F.col("mine").alias("a"), one, "label")
    placed = joined(placed, compared(full_sets(docs, asked, size), percent))
    large = placed.filter("blocks > 1").select("h1", "h2", "n", "first", "root", "label")
    if large.isEmpty():
        return placed.select("h1", "h2", F.col("label").alias("root"))
    sets = save(full_sets(docs, large.select("h1", "h2", "first"), size).dropDuplicates(["h1", "h2"]))
    large = large.drop("first")
    # a few sets of each component of two or more meet, a component's in one block
    some = Window.partitionBy("root", "label").orderBy(F.xxhash64("h1", "h2"), "h1", "h2")
    while True:
        most = large.groupBy("root", "label").count().filter("count > 1").drop("count")
        several = most.groupBy("root").count().filter("count > 1") \
            .select("root", F.ceil(F.col("count") * LEADERS / block).cast("int").alias("blocks"))
        leaders = large.withColumn("nth", F.row_number().over(some)).filter(F.col("nth") <= LEADERS) \
            .join(most, ["root", "label"], "left_semi").join(several, "root") \
            .withColumn("a", F.pmod(F.xxhash64("label"), "blocks").cast("int"))
        leaders = save(sized(leaders.select("h1", "h2", "root", "a", one, "label", "blocks"), n_placed))
        met = save(compared(sets.join(leaders.drop("blocks"), ["h1", "h2"]), percent))
        large = joined(large, met)
        if met.isEmpty() or leaders.filter("blocks > 1").isEmpty():
            break
    # what else may be linked shares a shingle of the prefixes
    near = by_prefix(sets.join(large.select("h1", "h2", "label"), ["h1", "h2"]), percent, block)
    groups = large.drop("root").join(components(near).withColumnRenamed("node", "label"), "label")
    # in each such group the sets outside the largest component meet all
    sizes = groups.groupBy("root", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("items"))
    sizes = sizes.groupBy("root").agg(F.max(F.struct("sets", "label")).alias("top"), F.sum("sets").alias("sets"),
                                      F.sum("items").alias("items"))
    parts = [F.greatest(F.ceil(c / block), F.ceil(F.col("items") / BLOCK_SHINGLES), F.lit(1)).cast("int")
             for c in (F.col("sets"), F.col("sets") - F.col("top.sets"))]
    sizes = sizes.select("root", F.col("top.label").alias("top"), parts[0].alias("blocks"), parts[1].alias("chunks"))
    groups = groups.join(sizes, "root").select("h1", "h2", "root", "label", "top", "blocks", "chunks")
    groups = save(sized(groups, n_placed))
    everyone = groups.select("h1", "h2", "root", "label", F.pmod(F.xxhash64("h1", "h2"), "blocks").cast("int").alias("a"),
                             F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("b"))
    others = groups.filter("label <> top").select(
        "h1", "h2", "root", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"),
        F.pmod(F.xxhash64("h1", "h2"), "chunks").cast("int").alias("b"))
    last = components(compared(sets.join(everyone.union(others), ["h1", "h2"]), percent))
    named = large.join(last.withColumnsRenamed({"node": "label", "root": "last"}), "label", "left") \
        .select("h1", "h2", F.coalesce("last", "label").alias("root"))
    return named.union(placed.filter("blocks = 1").select("h1", "h2", F.col("label").alias("root")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK,
                    side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row (doc_id, text)."""
    rows = save(described(docs, size, side, width))
    of_set = F.min("doc_id").alias("first"), F.max("n").alias("n"), F.min("bands").alias("bands")
    nodes = save(rows.filter("n > 0").groupBy("h1", "h2").agg(*of_set))
    roots = _links(docs, nodes, size, percent, block, side)
    named = nodes.select("h1", "h2", "first").join(roots, ["h1", "h2"], "left") \
        .withColumn("root", F.coalesce("root", F.struct("h1", "h2")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "component_id")
    return rows.drop("bands").join(named, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
