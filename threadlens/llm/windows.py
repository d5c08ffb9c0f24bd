"""Fixed-length windows of long sequences, and the gram that stands for each.

A window is ``LENGTH`` consecutive symbols (words or bytes) of one document. Its
gram is the one with the least hash among the runs of ``gram`` symbols inside
it, so equal windows have equal grams, and neighbouring windows mostly share
theirs: a run of windows with one gram is a segment, and a document has far
fewer segments than windows. A unit with ``longer`` lengths takes the gram among
the places where a run of the longest of them, too, lies inside the window: the
gram is then a prefix of the suffix that starts there, and the longer runs are
longer prefixes of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 50
#: A segment holds at most so many windows, one for each bit of a long.
MOST = 62
_CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> np.ndarray:
    """A 64-bit number for each byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


class WordSymbols(dict):
    """64-bit numbers of words, remembering up to a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def rolling(symbols: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` symbols, by doubling."""
    with np.errstate(over="ignore"):
        done, out, size, part = 0, None, 1, symbols
        n = len(symbols) - length + 1
        while True:
            if length & size:
                shifted = part[done:done + n]
                out = shifted.copy() if out is None else out * _power(size) + shifted
                done += size
            size *= 2
            if size > length:
                break
            half = size // 2
            part = part[:-half] * _power(half) + part[half:]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def sliding_first(x: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least of every ``width`` neighbours is, by doubling."""
    at, size = np.arange(len(x)), 1
    while size < width:
        shift = min(size, width - size)
        a, b = at[:-shift], at[shift:]
        at = np.where(x[b] < x[a], b, a)
        size += shift
    return at


def within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted values."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def segments(symbols: np.ndarray, gram: int, length: int = LENGTH,
             longer: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, first window, number of windows) of the segments, in chunks.

    With ``longer`` lengths, rising, the hashes are rows: of the gram, and of the
    longer runs that start with it.
    """
    windows = len(symbols) - length + 1
    width = length - (longer[-1] if longer else gram) + 1  # places of the gram in a window
    for lo in range(0, max(windows, 0), _CHUNK):
        hi = min(windows, lo + _CHUNK)
        part = symbols[lo:hi + length - 1]
        if longer:
            at = sliding_first(rolling(part, gram)[:hi - lo + width - 1], width)
            least = np.stack([rolling(part, k)[at] for k in (gram, *longer)], axis=1)
            new = (least[1:] != least[:-1]).any(axis=1)
        else:
            least = sliding_least(rolling(part, gram), width)
            new = least[1:] != least[:-1]
        start = np.flatnonzero(np.concatenate([[True], new]))
        n = np.diff(np.append(start, hi - lo))
        pieces = -(-n // MOST)
        if (pieces > 1).any():  # repetitive text: one gram for long
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.repeat(start, pieces) + nth * MOST
            n = np.minimum(np.repeat(n, pieces) - nth * MOST, MOST)
        yield least[start], start + lo, n


class Bytes:
    """A text as its UTF-8 bytes."""

    gram, longer = 20, ()
    in_group, in_part = False, 2

    def __init__(self):
        self.table = byte_symbols()

    def units(self, text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def symbols(self, units: bytes) -> np.ndarray:
        return self.table[np.frombuffer(units, np.uint8)]

    @staticmethod
    def parsed(payload: bytes) -> bytes:
        return payload

    @staticmethod
    def cut(units: bytes, lo: int, hi: int) -> bytes:
        return units[lo:hi]

    @staticmethod
    def keep(units: bytes, kept: np.ndarray) -> bytes:
        return np.frombuffer(units, np.uint8)[kept].tobytes()


class Words:
    """A text as its words: runs of anything but the six ASCII separators."""

    gram, longer = 8, (16, 32)
    in_group, in_part = True, 1

    def __init__(self):
        self.known = WordSymbols()

    def units(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").split()

    def symbols(self, units: list[bytes]) -> np.ndarray:
        return self.known.of(units)

    @staticmethod
    def parsed(payload: bytes) -> list[bytes]:
        return payload.split(b" ")

    @staticmethod
    def cut(units: list[bytes], lo: int, hi: int) -> bytes:
        return b" ".join(units[lo:hi])

    @staticmethod
    def keep(units: list[bytes], kept: np.ndarray) -> bytes:
        return b" ".join(compress(units, kept.tolist()))


#: Text a group of documents holds, and text whose grams one task of the filter counts, in bytes.
GROUP_BYTES = 2 << 20
PART_BYTES = 16 << 20
#: A part holds the segments of at most so many documents. A gram that more share is hot: the next longer
#: one decides, in the end the whole window.
HOT = 20_000
#: Distinct segments that are indexed together, in bytes, and the rows that refer to them.
INDEX_BYTES, INDEX_ROWS = 1 << 20, 200_000
#: Rows of one key that wait for their marks.
PLACES = 400_000
#: Segments of more than twice INDEX_BYTES are cut by longer runs first, the last one a whole window.
RUNS = (24, 32, LENGTH)
#: The mask of a text that loses all its windows.
EVERY = -1
_SEGMENTS = "key long, payload binary, n int, doc long, dkey long, lo long, mask long"
_SPANS = "doc long, dkey long, lo long, mask long"


def keys_of(grams: np.ndarray, wanted: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a segment's lengths (columns) is its key, and whether others share it.

    The shortest that is not hot; one past the last column if all are.
    """
    hot = within(grams.ravel(), often).reshape(grams.shape)
    level = np.argmin(np.concatenate([hot, np.zeros((len(hot), 1), bool)], axis=1), axis=1)
    key = grams[np.arange(len(grams)), np.minimum(level, grams.shape[1] - 1)]
    return level, within(key, wanted)


def in_pieces(mark: Callable, unit: Bytes | Words, payloads: list[bytes], n: np.ndarray, first: np.ndarray,
              runs: tuple[int, ...] = RUNS) -> np.ndarray:
    """What ``mark`` tells of the segments, which are indexed in pieces of bounded size.

    One key may have any number of segments, as a document may hold its gram many times.
    Equal windows have the same least run, so segments are cut where that changes, and
    what shares one stays in one piece, which is cut by the next longer run if it is too large.
    """
    if not runs or sum(map(len, payloads)) <= 2 * INDEX_BYTES:
        return mark(payloads, n, first)
    width = LENGTH - runs[0] + 1
    ids: dict[bytes, int] = {}
    keys, least, size, of, windows = [], [], [], [], []
    ends = np.cumsum([len(p) for p in payloads])
    cuts = [0, *(np.flatnonzero(np.diff(ends // _CHUNK)) + 1).tolist(), len(payloads)]
    for lo, hi in zip(cuts, cuts[1:]):
        units = [unit.parsed(p) for p in payloads[lo:hi]]
        m = n[lo:hi]
        segment, offset = np.repeat(np.arange(hi - lo), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        start = np.cumsum(m + LENGTH - 1) - (m + LENGTH - 1)
        symbols = np.concatenate([unit.symbols(x) for x in units])
        run = sliding_least(rolling(symbols, runs[0]), width)[start[segment] + offset]
        new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (segment[1:] != segment[:-1])]))
        count = np.diff(np.append(new, len(run)))
        for k, s, i, c in zip(run[new].tolist(), segment[new].tolist(), offset[new].tolist(), count.tolist()):
            j = ids.setdefault(unit.cut(units[s], i, i + c + LENGTH - 1), len(ids))
            if j == len(keys):
                keys.append(k)
                least.append(first[lo + s])
                size.append(c)
            else:
                least[j] = min(least[j], first[lo + s])
            of.append(j)
            windows.append(c)
    key, least, size = np.array(keys, np.uint64), np.array(least, np.int64), np.array(size, np.int64)
    parts, order = list(ids), np.argsort(key, kind="stable")
    base = np.cumsum(size) - size
    found = np.empty(size.sum(), np.int64)
    held, lo = 0, 0
    for hi in range(1, len(order) + 1):
        held += len(parts[order[hi - 1]])
        if hi == len(order) or held > INDEX_BYTES and key[order[hi]] != key[order[hi - 1]]:
            some = order[lo:hi]
            m = size[some]
            at = np.repeat(base[some], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            found[at] = in_pieces(mark, unit, [parts[i] for i in some], m, least[some], runs[1:])
            held, lo = 0, hi
    of, windows = np.array(of), np.array(windows)
    return found[np.repeat(base[of], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)]


class Bundle:
    """Segments of some keys, the places that hold them, and the marks of those places.

    Only segments whose key has ``several`` go through ``mark``; copies of any other
    are told by its first document.
    """

    def __init__(self, mark: Callable, unit: type, several: int):
        self.mark, self.unit, self.several = mark, unit(), several
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.n: list[int] = []
        self.first: list[int] = []
        self.keys: list[int] = []
        self.places: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, key: int, payload: bytes, n: int, doc: int, dkey: int, lo: int) -> None:
        i = self.ids.setdefault(payload, len(self.ids))
        if i == len(self.first):
            self.n.append(n)
            self.first.append(doc)
            self.keys.append(key)
            self.size += len(payload)
        elif doc < self.first[i]:
            self.first[i] = doc
        self.places.append((i, doc, dkey, lo))

    def marks(self) -> tuple[np.ndarray, ...]:
        """Segment, doc, dkey, lo of every place, and its windows that also start in a smaller document, as bits."""
        if not self.places:
            return tuple(np.zeros((5, 0), np.int64))
        n = np.array(self.n, np.int64)
        first, base = np.array(self.first, np.int64), np.cumsum(n) - n
        least = np.repeat(first, n)
        _, where, many = np.unique(np.array(self.keys, np.int64), return_inverse=True, return_counts=True)
        use = many[where] >= self.several
        if use.any():
            least[np.repeat(use, n)] = in_pieces(self.mark, self.unit, list(compress(self.ids, use)), n[use], first[use])
        of, doc, dkey, lo = np.array(self.places, np.int64).T
        bits = (np.int64(1) << n[of]) - 1  # of a copy that is not left to ``mark``
        lead = np.flatnonzero((doc == first[of]) | (self.several == 1))  # none, if the first have had their marks
        for some in np.array_split(lead, -(-len(lead) // 16384)) if len(lead) else ():
            m = n[of[some]]
            start = np.cumsum(m) - m
            offset = np.arange(m.sum()) - np.repeat(start, m)
            late = np.repeat(doc[some], m) > least[np.repeat(base[of[some]], m) + offset]
            bits[some] = np.add.reduceat(late.astype(np.int64) << offset, start)
        return of, doc, dkey, lo, bits


def _unpack(parts: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype)


def row_hash(*columns: str) -> Column:
    """Tells rows of one doc_id apart, and deals them out."""
    return F.xxhash64(*columns)


def removed(docs: DataFrame, unit: type, mark: Callable, finish: Callable, schema: T.StructType,
            length: int = LENGTH, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """Find every window that also starts in a document with a smaller id, and finish each text.

    ``docs`` has doc_id and text; ``unit`` is Words or Bytes. ``mark(payloads, n, first)``
    indexes distinct segments of ``n`` windows, held by documents the smallest of which
    are ``first``, and tells for each window, in order, the smallest document that it
    starts in. ``finish(table, covered)`` turns a group of documents, and for
    each the array of its removed units (None: none), into the result.

    Documents are dealt into groups by a hash, with one shuffle of the texts that
    all steps share. Texts that are whole copies of one in a smaller document are
    told apart first, by two hashes and their length: all their windows go, and
    they take no part in what follows. 1) A group's distinct grams, as packed numbers, go to the
    part of their hash, which tells each group those that other documents have,
    too, and those that are hot. 2) Groups index and mark the segments of such grams among themselves
    and send those with windows left to the key's hash, whole. The key is the
    gram, or the shortest longer one that is not hot. 3) There segments are indexed
    and marked. 4) The marks go back to the groups.
    Grams are compared by hash, which may only let needless segments through;
    windows are compared by content, but for those of whole copies, which are equal
    by hash. A row is known by its doc_id and a hash of its text, so that rows of
    different ids are never mixed up. If ``unit.in_group`` is set and ``unit.in_part`` is 1, all
    marks but those of whole copies come from ``mark``. Else step 2 only looks for copies of segments, and
    step 3 indexes the segments of keys that have at least ``in_part``.
    """
    rows = docs.select("doc_id", "text", row_hash("doc_id", "text").alias("dkey"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups, n_parts = -(-total // group_bytes) + 1, -(-total // PART_BYTES) + 1
    rows = rows.withColumn("b", F.pmod("dkey", F.lit(n_groups)))
    space = n_parts << 32

    def gram_of(h: np.ndarray) -> np.ndarray:
        return h % np.uint64(space)

    def grams(key: tuple, table: pa.Table, copies: pa.Table) -> pa.Table:
        u, found = unit(), []
        copied = set(zip(copies["of"].to_pylist(), copies["copy"].to_pylist())) if "copy" in copies.column_names else ()
        for doc, dkey, text in zip(*(table[c] for c in ("doc_id", "dkey", "text"))) if len(table) else ():
            if doc.is_valid and text.is_valid and (doc.as_py(), dkey.as_py()) not in copied:
                own = [h.ravel() for h, _, _ in segments(u.symbols(u.units(text.as_py())), u.gram, length, u.longer)]
                if own:
                    found.append(np.unique(gram_of(np.concatenate(own))))
        gram, count = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
        part = (gram % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rest, count = (gram // np.uint64(n_parts)).astype("<u4")[order], np.minimum(count, 65535).astype("<u2")[order]
        parts, start = np.unique(part[order], return_index=True)
        ends = [*start[1:].tolist(), len(rest)]
        return pa.table({"part": pa.array(parts, pa.int64()), "b": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                         "rest": pa.array([rest[i:j].tobytes() for i, j in zip(start, ends)], pa.binary()),
                         "count": pa.array([count[i:j].tobytes() for i, j in zip(start, ends)], pa.binary())})

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        rests = [x.as_py() for x in table["rest"]]
        gram, count = _unpack(rests, "<u4"), _unpack([x.as_py() for x in table["count"]], "<u2")
        _, where = np.unique(gram, return_inverse=True)
        docs_with = np.bincount(where, count)[where] if len(gram) else np.zeros(0)
        ends = np.cumsum([len(x) // 4 for x in rests])
        full = gram.astype(np.uint64) * np.uint64(n_parts) + np.uint64(key[0].as_py())
        out = []
        for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
            g, c = full[i:j], docs_with[i:j]
            out.append((g[c >= 2].tobytes(), g[c > hot].tobytes()))
        return pa.table({"b": table["b"], "shared": pa.array([x for x, _ in out], pa.binary()),
                         "hot": pa.array([x for _, x in out], pa.binary())})

    def cut(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if "doc_id" in table.column_names and "shared" in told.column_names:
            wanted, often = (np.sort(_unpack([x.as_py() for x in told[c].drop_null()], "<u8")) for c in ("shared", "hot"))
            copied = {x for x in zip(told["of"].to_pylist(), told["copy"].to_pylist()) if x[1] is not None}
            u, sent = unit(), []
            for doc, dkey, text in sorted(zip(table["doc_id"].to_pylist(), table["dkey"].to_pylist(), table["text"]),
                                          key=lambda r: (r[0] is None, r[0] or 0)):
                if doc is None or not text.is_valid:
                    continue
                if (doc, dkey) in copied:
                    out.append((dkey, None, 0, doc, dkey, 0, EVERY))
                    continue
                units = u.units(text.as_py())
                for h, lo, n in segments(u.symbols(units), u.gram, length, u.longer):
                    h = h.reshape(len(lo), -1)
                    level, take = keys_of(gram_of(h), wanted, often)
                    short = take & (level < h.shape[1])
                    for k, i, m in zip(h[short, level[short]].view(np.int64).tolist(), lo[short].tolist(), n[short].tolist()):
                        sent.append((k, u.cut(units, i, i + m + length - 1), m, doc, dkey, i))
                    for first, m in zip(lo[take & ~short].tolist(), n[take & ~short].tolist()):
                        for i in range(first, first + m):
                            window = u.cut(units, i, i + length)
                            sent.append((xxhash.xxh64_intdigest(window, 11) - (1 << 63), window, 1, doc, dkey, i))
            # marks within the group first: what is left of it goes on
            for row, bits in marked(sent, u.in_group):
                if bits:
                    out.append((row[4], None, 0, row[3], row[4], row[5], bits))
                if bits != (1 << row[2]) - 1:
                    out.append((*row, 0))
        columns = list(zip(*out)) or [[]] * 7
        types = [pa.int64(), pa.binary(), pa.int32(), *[pa.int64()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)],
                        ["key", "payload", "n", "doc", "dkey", "lo", "mask"])

    def marked(sent: list[tuple], indexed: bool) -> Iterator[tuple[tuple, int]]:
        """The rows of a group, which come by rising document, each with the bits of its marks."""
        if not indexed:
            least: dict[bytes, int] = {}
            for row in sent:
                yield row, 0 if least.setdefault(row[1], row[3]) == row[3] else (1 << row[2]) - 1
            return
        sent.sort(key=itemgetter(0))
        bundle, lo = Bundle(mark, unit, 1), 0
        for hi in range(1, len(sent) + 1):
            bundle.add(*sent[hi - 1])
            if hi == len(sent) or bundle.size > INDEX_BYTES and sent[hi][0] != sent[hi - 1][0]:
                yield from zip(sent[lo:hi], bundle.marks()[-1].tolist())
                bundle.clear()
                lo = hi

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, last = Bundle(mark, unit, unit.in_part), None

        def found() -> pa.RecordBatch:
            _, *place, bits = bundle.marks()
            return pa.RecordBatch.from_arrays([pa.array(x[bits != 0]) for x in (*place, bits)],
                                              ["doc", "dkey", "lo", "mask"])

        for batch in batches:
            settled = []
            for key, payload, n, doc, dkey, lo, mask in zip(*(batch[c].to_pylist() for c in (
                    "key", "payload", "n", "doc", "dkey", "lo", "mask"))):
                if payload is None:
                    settled.append((doc, dkey, lo, mask))
                    continue
                if key != last and (bundle.size > INDEX_BYTES or len(bundle.places) > INDEX_ROWS):
                    yield found()
                    bundle.clear()
                elif len(bundle.places) > PLACES:
                    # a key's rows come by rising document, so later ones change no mark
                    yield found()
                    bundle.places = []
                last = key
                bundle.add(key, payload, n, doc, dkey, lo)
            if settled:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*settled)],
                                                 ["doc", "dkey", "lo", "mask"])
        yield found()

    def end(key: tuple, table: pa.Table, spans: pa.Table) -> pa.Table:
        u = unit()
        if "doc_id" not in table.column_names:
            return finish(None, u, [])
        bad: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if "mask" in spans.column_names:
            for doc, dkey, lo, mask in zip(*(spans[c].to_pylist() for c in ("doc", "dkey", "lo", "mask"))):
                bad.setdefault((doc, dkey), []).append((lo, mask))
        texts = []
        for *row, text in zip(table["doc_id"].to_pylist(), table["dkey"].to_pylist(), table["text"]):
            units, covered = u.units(text.as_py() or ""), None
            if tuple(row) in bad:
                step = np.zeros(len(units) + 1, np.int64)
                if (0, EVERY) in bad[tuple(row)] and len(units) >= length:
                    step[0], step[-1] = 1, -1
                for lo, mask in bad[tuple(row)]:
                    if mask == EVERY:
                        continue
                    at = lo + np.flatnonzero(np.unpackbits(np.array([mask], "<i8").view(np.uint8), bitorder="little"))
                    np.add.at(step, at, 1)
                    np.add.at(step, at + length, -1)
                covered = np.cumsum(step)[:-1] > 0
            texts.append((units, covered))
        return finish(table, u, texts)

    whole = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.octet_length("text")).alias("whole")
    texts = rows.filter("doc_id is not null and text is not null").select("doc_id", "dkey", whole)
    least = texts.groupBy("whole").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = texts.join(least, "whole").filter("doc_id > least").select(F.col("doc_id").alias("of"), F.col("dkey").alias("copy"))
    copies = copies.select(F.pmod("copy", F.lit(n_groups)).alias("b"), "of", "copy")

    asked = rows.groupBy("b").cogroup(copies.groupBy("b")) \
        .applyInArrow(grams, "part long, b long, rest binary, count binary")
    told = asked.groupBy("part").applyInArrow(shared, "b long, shared binary, hot binary") \
        .unionByName(copies, allowMissingColumns=True)
    found = rows.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(cut, _SEGMENTS)
    spans = found.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(index, _SPANS) \
        .withColumn("b", F.pmod("dkey", F.lit(n_groups)))
    return rows.groupBy("b").cogroup(spans.groupBy("b")).applyInArrow(end, schema)
