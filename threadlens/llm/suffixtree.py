"""Substring dedup over words by suffix trees partitioned by gram.

A word is removed if a window of ``LENGTH`` words that covers it also starts in a
document with a smaller id. All suffixes of all documents would make one
generalised suffix tree; its deep internal nodes (those at a depth of LENGTH
words or more) are the repeats sought. The tree is built in parts by prefixes of
variable length. A suffix goes with the anchor among its first words: the suffix
starting there whose first 8 words have the least hash, so that neighbours mostly
share an anchor and travel as one segment. Parts are prefixes of anchors: 8 words,
and where more documents share them than a part may hold (counted beforehand), 16,
then 32, and last the whole window. Prefixes of one document only are leaves
and go nowhere. So every part fits in memory, and each repeat lies in one part.
Trees are built twice: over the suffixes of a group of documents, so that a repeat
leaves the group once, and over what is left, by prefix. Only whole copies of
a text (by hash) are settled without a tree (``windows.removed``).

A part's tree is held as its sorted leaves and the longest common prefixes of
neighbours: the internal nodes are the intervals of neighbours that share a
prefix, the deep ones those that share LENGTH words. The smallest document below
a deep node is the one that keeps the words.

Defined results: null texts have no words; texts under LENGTH words lose nothing;
rows with a null id take no part and lose nothing; rows with the same id never
remove each other's words, and repeated rows get the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .windows import LENGTH, Words, removed


def leaves(sequence: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in sorted order, and the common prefix of each with the one before.

    Prefixes are compared up to ``depth`` symbols. Ranks of prefixes of 1, 2, 4 ...
    symbols are found by doubling; those levels give the common prefixes as well.
    """
    n = len(sequence)
    levels, size = [np.unique(sequence, return_inverse=True)[1].astype(np.int64)], 1
    while size * 2 <= depth:
        rank = levels[-1]
        pair = rank * (n + 1)
        pair[:n - size] += rank[size:] + 1
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        size *= 2
    tail = starts + depth - size  # two overlapping prefixes make the whole depth
    order = np.lexsort((levels[-1][np.minimum(tail, n - 1)], levels[-1][starts]))
    order = starts[order]
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        width = 1 << level
        for _ in range(2 if width == size else 1):  # the longest level may fit twice
            inside = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
            common += same * width
            a, b = a + same * width, b + same * width
    return order, np.minimum(common, depth)


def mark(payloads: list[bytes], n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The smallest document below the deep node of each window of the segments, in order."""
    ids: dict[bytes, int] = {}
    number, lengths = [], []
    for payload in payloads:
        words = payload.split(b" ")
        number += [ids.setdefault(w, len(ids)) for w in words]
        lengths.append(len(words))
        number.append(-len(lengths))  # an end that equals nothing
    at = np.cumsum(np.array(lengths) + 1) - np.array(lengths) - 1
    segment = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, common = leaves(np.array(number, np.int64), at[segment] + offset)
    # leaves below one deep node are neighbours that share the whole depth
    node = np.concatenate([[0], np.cumsum(common < LENGTH)])
    where = np.searchsorted(at, order, side="right") - 1
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    least = np.empty(len(order), np.int64)
    least[(np.cumsum(n) - n)[where] + order - at[where]] = np.minimum.reduceat(first[where], start)[node]
    return least


_FIELDS = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
_KEPT = T.StructField("kept", T.StringType())


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``with_text``) the kept words of every row (doc_id, text)."""
    fields = [*_FIELDS, _KEPT] if with_text else _FIELDS

    def finish(table: pa.Table | None, unit: Words, texts: list) -> pa.Table:
        kept = [b" ".join(units) if covered is None else unit.keep(units, ~covered) for units, covered in texts]
        columns = [table["doc_id"].combine_chunks().cast(pa.int64()) if table is not None else pa.array([], pa.int64()),
                   pa.array([len(u) for u, _ in texts], pa.int64()),
                   pa.array([0 if c is None else int(c.sum()) for _, c in texts], pa.int64()),
                   pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        if with_text:
            columns.append(pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()))
        return pa.table(columns, [f.name for f in fields])

    return removed(docs, Words, mark, finish, T.StructType(fields))
