"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit for each of the 64 bits of a shingle's hash,
set if more than half of the shingles' hashes have it. Documents whose
fingerprints differ in at most ``radius`` bits are linked, and components of
links are groups.

Each bit position i gets a nonzero vector f(i) of radius + 1 binary digits, and
each nonzero vector v a table whose mask keeps the positions with an odd number
of common ones in f(i) and v. Any ``radius`` positions span less than the whole
space, so some v is orthogonal to all their vectors, and its mask drops every
differing bit: two linked fingerprints always meet in some table. There are
2^(radius + 1) - 1 tables, and no link is lost.

Only distinct fingerprints enter the tables. A bucket larger than ``BLOCK`` is
split into blocks by a hash, and each pair of blocks is compared in a task of its
own. Each comparison sends on a spanning forest of its links, not all pairs.
Components are found by alternating large-star and small-star steps, with a
checkpoint each round.

Defined results: texts without words, null ones included, have fingerprint 0 and
are linked like any other; rows with a null id are linked but name no group,
unless all of a group are such (then the group's id is null); repeated rows
share a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import save

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 1024
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the six separators
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size) + np.arange(len(words))
    start = end - size
    if len(words) >= shingle:
        start, end = start[:len(words) - shingle + 1], end[shingle - 1:]
    else:
        start, end = start[:1], end[-1:]
    digest, n = xxhash.xxh64_intdigest, len(start)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(start[lo:lo + _CHUNK].tolist(), end[lo:lo + _CHUNK].tolist())], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("*",),
                 shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns as a struct ``row`` and the fingerprint ``fp`` as a (signed) long."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch["body"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(fp)], ["row", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())]))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The tables' masks, as signed 64-bit numbers."""
    n = 2 ** (radius + 1) - 1
    vectors = [i % n + 1 for i in range(bits)]
    out = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i, f in enumerate(vectors) if (f & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that join what the links within ``left``, or between the two, join."""
    nodes = left if right is None else np.concatenate([left, right])
    other = nodes if right is None else right
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ other.view(np.uint64)[None, :]) <= radius
    i, j = np.nonzero(near)
    j = j + (0 if right is None else len(left))
    order = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")  # labels: ranks of the values
    label = order.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        root = new.copy()
        root[order] = new  # by rank
        new = root[new]
        if (new == label).all():
            break
        label = new
    by_rank = np.empty_like(nodes)
    by_rank[order] = nodes
    joined = by_rank[label]
    moved = joined != nodes
    return nodes[moved], joined[moved]


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (u, v), u > v, whose components are those of all links between distinct fingerprints ``fp``."""
    tables = F.array(*[F.lit(m).cast("long") for m in masks(radius)])
    entries = nodes.select("fp", F.posexplode(tables).alias("t", "mask")) \
        .select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    buckets = entries.groupBy("t", "key").count().filter("count > 1") \
        .select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = entries.join(buckets, ["t", "key"]).select("t", "key", "fp", mine.alias("mine"), "blocks")
    met = met.select("t", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("t", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
                (F.col("mine") > F.col("other")).alias("second"), "fp")
    met = met.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_u, out_v, kept = [], [], None

        def flush() -> pa.RecordBatch:
            u = np.concatenate([*out_u, np.zeros(0, np.int64)])
            v = np.concatenate([*out_v, np.zeros(0, np.int64)])
            out_u.clear()
            out_v.clear()
            pairs = np.unique(np.stack([u, v], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        def group(columns: list[np.ndarray]) -> None:
            a, b, second, fp = columns[2], columns[3], columns[4], columns[5]
            if a[0] == b[0]:
                found = forest(fp, None, radius)
            else:
                found = forest(fp[~second], fp[second], radius)
            out_u.append(found[0])
            out_v.append(found[1])

        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("t", "key", "a", "b", "second", "fp")]
            if kept is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(kept, columns)]
            if not len(columns[0]):
                continue
            new = np.zeros(len(columns[0]), bool)
            for c in columns[:4]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            bounds = [0, *starts.tolist()]
            # pairs, the most common groups, are compared together
            lengths = np.diff([*bounds])
            two = np.array(bounds[:-1], np.int64)[lengths == 2] if len(lengths) else np.zeros(0, np.int64)
            same = two[(columns[2][two] == columns[3][two])]
            x, y = columns[5][same], columns[5][same + 1]
            near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= radius
            out_u.append(np.maximum(x, y)[near])
            out_v.append(np.minimum(x, y)[near])
            done = set(same.tolist())
            for lo, hi in zip(bounds, bounds[1:]):
                if lo not in done:
                    group([c[lo:hi] for c in columns])
            kept = [c[bounds[-1]:] for c in columns]
            yield flush()
        if kept is not None and len(kept[0]):
            group(kept)
            yield flush()

    return met.mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the component's least node."""
    edges = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        # large star: a node's larger neighbours link to the least of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v") \
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = save(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = now


def groups(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fp, first (its least ``doc_id``), root and component_id (the component's least ``doc_id``) from (doc_id, fp)."""
    nodes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), radius, block))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return nodes.join(least, "root").select("fp", "first", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row (doc_id, text)."""
    fps = save(fingerprints(docs, keep=("doc_id",), shingle=shingle).select("row.doc_id", "fp"))
    return fps.join(groups(fps, radius).select("fp", "component_id"), "fp") \
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group, the one with the least doc_id (of rows that repeat it, any one)."""
    text, row = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    # texts are cut into shingles once; after that a row is known by its id and two hashes of its text
    known = docs.select("doc_id", "text", F.struct(text.alias("t1"), row.alias("t2")).alias("of"))
    fps = save(fingerprints(known, keep=("doc_id", "of"), shingle=shingle).select("row.doc_id", "row.of", "fp"))
    # a null id is chosen only where a group has no other
    roots = groups(fps.select("doc_id", "fp"), radius).select("fp", "root")
    one = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "fp", "of")).alias("kept")
    least = fps.groupBy("fp").agg(one).join(roots, "fp").groupBy("root").agg(F.min("kept").alias("kept"))
    chosen = least.select(F.col("kept.doc_id").alias("id"), F.col("kept.of.t1").alias("k1"), F.col("kept.of.t2").alias("k2"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_of"), text.alias("t1"), row.alias("t2"))
    rows = rows.join(chosen, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
                     & F.col("id_of").eqNullSafe(F.col("id")), "left_semi")
    same = Window.partitionBy("t1", "t2", "id_of").orderBy("t1")
    return rows.withColumn("nth", F.row_number().over(same)).filter("nth = 1").select("row.*")
