"""Prefix trie of conversations, with count-min screening of prefix digests.

A node is a distinct sequence of first turns; its digest has 128 bits, from running
sums of the turns' hashes, each mixed with its position. So positions and digests come
from distributed running aggregates, and a conversation of any length is no single task.

A count-min sketch of all prefix digests (two bits a cell: none, one, more) never
estimates too little. Where the estimate is one, the prefix is proven to be one
conversation's, and all longer ones with it: these tails are nodes of one member, and
are emitted where they are read. Only prefixes that may be shared are shuffled and
grouped exactly. Prefixes are dealt into classes by their conversation's first turn, so
that a sketch keeps to ``CELLS`` cells a table, whatever the size of the input; a class
that a very common first turn makes larger has a fuller sketch, hence more rows to group,
and the same result.

Sums over subtrees need no walk through the trie. A node belongs to its least member, and
of a conversation's path it is always the lower part that belongs to it. So each
conversation c has two numbers: l(c), 1 if its last node is childless and its own, and
q(c), the bytes of its path's upper part, which belongs to others. A node whose path has b
bytes above it has sum(l) leaves and saves sum(max(0, q - b)) bytes, over its members.

Defined results: rows with a null conv_id take no part; turns are ordered by turn (null
first), role, then a digest of role and text, repeated rows all count; an empty table
gives no node, not even a root. Two different sequences would be one node if their
128-bit digests agreed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.ordered import block_bucket, positions, running
from threadlens.session import scratch_path

from .common import save

TABLES = 4
CELLS = 1 << 23
SHARD = 1 << 18
SPREAD = 4096
PART = 4096
HEAVY = 1000


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), m (a digest of role and text) and bytes of every turn of (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("m"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("nth"))  # so that repeated rows spread out; they are all alike
    return positions(turns, ["conv_id"], ["turn", "role", "m", "nth"], out="pos").select("conv_id", "pos", "m", "bytes")


def _spread(keys: DataFrame, length: str) -> DataFrame:
    """A copy of each conversation's row for every ``SPREAD`` of its turns."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(length) / SPREAD))))


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len, d, m, bytes) of the rebuilt conversations' turns, and (conv_id, len) of all conversations.

    Conversation c starts with the first h turns of conversation c - c % ``every``, h = crc32(c) % ``most``,
    and goes on with its own turns after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"),
                         (F.col("conv_id") - F.col("conv_id") % every).alias("base")) \
        .join(base, "base", "left") \
        .withColumn("first", F.least("h", F.coalesce("n_base", F.lit(0)))) \
        .withColumn("len", F.col("first") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = save(convs.select("conv_id", "base", "n", "h", "first", "len"))
    own = turns.withColumn("salt", F.floor(F.col("pos") / SPREAD)) \
        .join(_spread(convs, "n"), ["conv_id", "salt"]).filter("pos > h") \
        .select("conv_id", "len", (F.col("pos") - F.col("h") + F.col("first")).alias("d"), "m", "bytes")
    heads = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base") \
        .join(convs.filter("first > 0"), "base").filter("pos <= h") \
        .select("conv_id", "len", F.col("pos").alias("d"), "m", "bytes")
    return own.union(heads), convs.select("conv_id", "len")


_SUMS = ["s0", "s1", "s2", "s3"]


def _digest(sums: list[Column], depth: Column) -> tuple[Column, Column]:
    return F.xxhash64(*sums, depth), F.xxhash64(depth, *reversed(sums), F.lit(7))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every conversation and depth: conv_id, len, d, the digests of the prefix (k1, k2) and of its
    parent (p1, p2, null at the root), bytes of the last turn, of the path before it, and the first turn's hash."""
    e, f = F.xxhash64("m", "d"), F.xxhash64("d", "m", F.lit(1))
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = [e.bitwiseAND(low), F.shiftrightunsigned(e, 32), f.bitwiseAND(low), F.shiftrightunsigned(f, 32)]
    turns = turns.select("conv_id", "len", "d", "bytes", F.when(F.col("d") == 1, F.xxhash64("m")).alias("first"),
                         *[p.alias(f"t{i}") for i, p in enumerate(parts)])
    # halves of hashes add up to less than 2^63 in any conversation of less than 2^31 turns
    sums = running(save(turns), ["conv_id"], ["d"],
                   {**{s: ("sum", f"t{i}") for i, s in enumerate(_SUMS)}, "path": ("sum", "bytes"),
                    "top": ("max", "first")}, bucket=block_bucket("d", SPREAD))
    k1, k2 = _digest([F.col(s) for s in _SUMS], F.col("d"))
    p1, p2 = _digest([F.col(s) - F.col(f"t{i}") for i, s in enumerate(_SUMS)], F.col("d") - 1)
    zero = [F.lit(0).cast("long")] * 4
    r1, r2 = _digest(zero, F.lit(0).cast("long"))
    none = F.lit(None).cast("long")
    roots = convs.select("conv_id", "len", F.lit(0).cast("long").alias("d"), r1.alias("k1"), r2.alias("k2"),
                         none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("bytes"),
                         F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("top"))
    return sums.select("conv_id", "len", "d", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "bytes",
                       (F.col("path") - F.col("bytes")).alias("before"), "top").union(roots)


def _places(k1: np.ndarray, k2: np.ndarray, cells: int) -> list[np.ndarray]:
    """The digests' cells in each table of the sketch."""
    a, b = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(t) * b) & np.uint64(cells - 1)).astype(np.int64) for t in range(TABLES)]


def _pack(counts: np.ndarray) -> np.ndarray:
    four = counts.reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6


def _unpack(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)


def sketch(keys: DataFrame, cells: int) -> np.ndarray:
    """The packed count-min sketch of the digests (k1, k2): at most TABLES * ``cells`` / 4 bytes."""
    shard = min(SHARD, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((TABLES, cells), np.uint8)
        for batch in batches:
            k1, k2 = (batch[c].to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for t, at in enumerate(_places(k1, k2, cells)):
                at, n = np.unique(at, return_counts=True)
                table[t, at] = np.minimum(2, table[t, at] + np.minimum(n, 2)).astype(np.uint8)
        flat = table.reshape(-1, shard)
        used = np.flatnonzero(flat.any(axis=1))
        for lo in range(0, len(used), 16):
            at = used[lo:lo + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array([_pack(flat[i]).tobytes() for i in at], pa.binary())], ["shard", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch["shard"].to_pylist(), batch["counts"].to_pylist()):
                new = _unpack(np.frombuffer(counts, np.uint8))
                held[at] = np.minimum(2, held[at] + new) if at in held else new
        for at, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([_pack(counts).tobytes()], pa.binary())],
                                             ["shard", "counts"])

    schema = "shard long, counts binary"
    whole = np.zeros((TABLES * cells // shard, shard // 4), np.uint8)
    # bounded by the sketch's size
    parts = keys.select("k1", "k2").mapInArrow(count, schema).repartition("shard").coalesce(len(whole))
    for row in parts.mapInArrow(add, schema).collect():
        whole[row.shard] = np.frombuffer(row.counts, np.uint8)
    return whole.reshape(-1)


def screened(paths: DataFrame, packed: np.ndarray, cells: int) -> DataFrame:
    """The rows with ``shared`` and ``above_shared``: whether the prefix, and its parent, may be another's, too."""
    held = paths.sparkSession.sparkContext.broadcast(packed)

    def more(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        many = np.ones(len(k1), bool)
        for t, at in enumerate(_places(k1, k2, cells)):
            at = at + t * cells
            many &= (held.value[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3) > 1
        return many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, p1, p2 = (batch[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "p1", "p2"))
            above = more(p1, p2) & batch["p1"].is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(more(k1, k2)), pa.array(above)],
                                             [*batch.schema.names, "shared", "above_shared"])

    columns = ", ".join(f"{name} {kind}" for name, kind in paths.dtypes)
    return paths.mapInArrow(run, f"{columns}, shared boolean, above_shared boolean")


def screen(paths: DataFrame, cells: int = CELLS) -> DataFrame:
    """All prefixes, screened class by class, as a table in the shared folder."""
    spark = paths.sparkSession
    paths = save(paths)
    n = paths.count()
    n_classes = max(1, -(-2 * n // cells))
    cells = min(cells, 1 << max(4, (2 * n - 1).bit_length()))
    out = scratch_path(spark, "prefixes")
    if n_classes > 1:  # a class is a folder; the salt keeps a common first turn from being one task
        by_class = scratch_path(spark, "prefix-classes")
        paths.withColumn("class", F.pmod("top", F.lit(n_classes))) \
            .repartition("class", F.pmod(F.xxhash64("conv_id"), F.lit(32))) \
            .write.partitionBy("class").parquet(by_class)
        for one in range(n_classes):
            part = spark.read.parquet(by_class).filter(F.col("class") == one).drop("class")
            screened(part, sketch(part, cells), cells).write.mode("append").parquet(out)
    else:
        screened(paths, sketch(paths, cells), cells).write.parquet(out)
    return spark.read.parquet(out)


def _ends(members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) over each node's conv_ids in order: runs of ids first, so no task lists them all."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (batch[c].to_numpy() for c in ("k1", "k2", "conv_id"))
            new = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
            cuts = sorted({0, *new.tolist(), *range(0, len(ids), PART)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(ids[cuts]),
                 pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)])],
                          pa.string())], ["k1", "k2", "least", "part"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for batch in batches:
            out = []
            for k1, k2, part in zip(*[batch[c].to_pylist() for c in ("k1", "k2", "part")]):
                if node != (k1, k2):
                    if node is not None:
                        out.append((*node, h.hexdigest()))
                    node, h = (k1, k2), hashlib.sha256(part.encode())
                else:
                    h.update(b"," + part.encode())
            yield _hashed(out)
        if node is not None:
            yield _hashed([(*node, h.hexdigest())])

    def _hashed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.string())], ["k1", "k2", "ends_sha256"])

    parts = members.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id") \
        .sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(runs, "k1 long, k2 long, least long, part string")
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "least") \
        .mapInArrow(hashes, "k1 long, k2 long, ends_sha256 string")


def _owner_above(rows: DataFrame, nodes: DataFrame, n_children: int) -> DataFrame:
    """The rows with parent_conv_id: the owner of their parent (p1, p2), or their own conv_id if no node is it.

    Nodes with a ``HEAVY``th of all children or more are at most ``HEAVY``: their owners are broadcast.
    """
    owners = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("o"), "n_children")
    heavy = F.col("n_children") * HEAVY >= max(1, n_children)
    hot = F.broadcast(owners.filter(heavy).drop("n_children"))
    rows = save(rows.join(hot, ["p1", "p2"], "left"))
    rest = rows.filter("o is null").drop("o").join(owners.filter(~heavy).drop("n_children"), ["p1", "p2"], "left")
    return rows.filter("o is not null").unionByName(rest) \
        .withColumn("parent_conv_id", F.when(F.col("p1").isNotNull(), F.coalesce("o", "conv_id"))).drop("o")


def trie(rows: DataFrame, every: int = 5, most: int = 9, cells: int = CELLS) -> DataFrame:
    """Every node of the trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text)."""
    turns, convs = rebuilt(turns_of(rows), every, most)
    paths = screen(prefixes(turns, convs), cells)
    digest = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    ends = F.when(F.col("d") == F.col("len"), digest).otherwise(F.sha2(F.lit("").cast("binary"), 256))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def single(tails: DataFrame, parent: Column) -> DataFrame:
        return tails.select("conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"),
                            (F.col("d") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"),
                            zero.alias("saved_tokens"), ends.alias("ends_sha256"))

    # proven singletons under proven singletons: nothing of them is shuffled
    tails = single(paths.filter("not shared and not above_shared and d > 0"), F.col("conv_id"))
    edge = paths.filter("not shared and (above_shared or d = 0)")
    members = paths.filter("shared")
    least = ["d", "bytes", "before", "p1", "p2"]
    nodes = save(members.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.count(F.when(F.col("d") == F.col("len"), 1)).alias("n_ends"), *[F.min(c).alias(c) for c in least]))
    kids = nodes.select("p1", "p2").union(edge.select("p1", "p2")).groupBy("p1", "p2") \
        .agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    nodes = save(nodes.join(kids, ["k1", "k2"], "left").fillna(0, ["n_children"]))

    # l and q of each conversation, see above
    last = paths.filter("d = len").select("conv_id", "len", (F.col("before") + F.col("bytes")).alias("q"),
                                          (~F.col("shared")).cast("long").alias("l"))
    no_len = F.lit(None).cast("long").alias("len")
    own = nodes.select("conv_id", no_len, F.col("before").alias("q"),
                       (F.col("n_ends") == F.col("n_convs")).cast("long").alias("l"))
    tops = edge.select("conv_id", no_len, F.col("before").alias("q"), zero.alias("l"))
    numbers = last.union(own).union(tops).groupBy("conv_id") \
        .agg(F.max("len").alias("len"), F.min("q").alias("q"), F.max("l").alias("l"))
    sums = members.select("conv_id", F.floor(F.col("d") / SPREAD).alias("salt"), "k1", "k2", "before") \
        .join(_spread(numbers, "len"), ["conv_id", "salt"]).groupBy("k1", "k2") \
        .agg(F.sum("l").alias("n_leaves"), F.sum(F.greatest(F.col("q") - F.col("before"), zero)).alias("saved_tokens"))
    hashed = _ends(members.filter("d = len"))
    n_children = nodes.agg(F.sum("n_children")).first()[0] or 0
    shared = nodes.join(sums, ["k1", "k2"]).join(hashed, ["k1", "k2"], "left") \
        .select("conv_id", F.col("d").alias("depth"), "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    shared = _owner_above(shared, nodes, n_children) \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    edge = _owner_above(edge.select("conv_id", "d", "len", "p1", "p2"), nodes, n_children)
    return shared.union(single(edge, F.col("parent_conv_id"))).union(tails)
