"""Byte-pair encoding of whole texts with a public vocabulary, and decoding.

A text is cut at the special tokens' strings, each piece is normalised (NFC, a
space for each white-space run, lower case), split by the vocabulary's pattern,
written as bytes, and every part is merged on its own: symbols stand in a doubly
linked list, a priority queue holds (rank, position) of each mergeable pair, and
an entry whose symbols have changed since it was queued is skipped. Decoding
concatenates the vocabulary's strings; this vocabulary has no decoder, so its
strings are joined with one space, as its library does.

The ids of parts already seen are remembered in a worker, in two generations of
bounded size, so that common parts are merged once and memory stays bounded.

Defined results: a null text is encoded as the empty one (no ids); repeated rows
and null ids are encoded like any others.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the vocabulary's pattern engine has it (control codes 1C-1F are none).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers among the first 256 code points, where the faster engine can split.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe"}
#: Letters and numbers that Unicode has since 17.0, or that the installed engine counts
#: already; the vocabulary's library knows Unicode 16.0.
NEWER = {
    r"\p{L}": r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
             r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
             r"\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
             r"\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
             r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
             r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
             r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
             r"\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
             r"\U000323b0-\U00033479\U0003d000-\U0003fc3f",
    r"\p{N}": r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"}
#: Lower case that the library knows and older Unicode tables do not.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
         0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
#: Positions in a queue entry take this many bits; the rank stands above them.
_BITS = 40
_LOW = (1 << _BITS) - 1
_NO_SPACE = re.compile(f"[^{SPACE}]+")
_CASED = re.compile(f"[{''.join(map(chr, LOWER))}]")
_CONTROL = re.compile(r"[\x1c-\x1f]")
#: Entries of each generation of each of a worker's two memories.
_REMEMBERED = 120_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks and strings of a word-end BPE vocabulary file."""

    def __init__(self, definition: dict):
        model = definition["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.size = len(self.ids)
        self.merges: dict[int, int] = {}  # left * size + right: rank
        self.made: list[int] = []  # by rank
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges.setdefault(self.ids[left] * self.size + self.ids[right], rank)
            self.made.append(self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in definition["added_tokens"]}
        self.strings = {i: s for s, i in {**self.ids, **self.special}.items()}
        split = next(p for p in definition["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the engine's \s differs from this one's in four control codes
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}")
        as_known = pattern
        for name, newer in NEWER.items():  # a class of its own, also where it stands in one
            as_known = as_known.replace(name, f"[{name}--[{newer}]]")
        self.split = regex.compile(as_known, regex.V1)
        for name, letters in LATIN.items():
            pattern = pattern.replace(f"[{name}]", f"[{letters}]").replace(name, letters)
        self.split_latin = re.compile(pattern)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        letters = byte_letters()
        self.byte = [self.ids[x] for x in letters]
        self.last_byte = [self.ids[x + self.end] for x in letters]

    def merge(self, part: str) -> list[int]:
        """Ids of one part."""
        data = part.encode("utf-8", "surrogatepass")
        symbol = [self.byte[b] for b in data]
        symbol[-1] = self.last_byte[data[-1]]
        n, size, rank_of, made = len(symbol), self.size, self.merges.get, self.made
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # the rank of the pair that starts at each symbol, -1 if it does not merge
        ranks = [rank_of(a * size + b, -1) for a, b in zip(symbol, symbol[1:])]
        queue = [rank << _BITS | i for i, rank in enumerate(ranks) if rank >= 0]
        ranks.append(-1)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> _BITS, entry & _LOW
            if ranks[i] != rank:
                continue  # stale: one of the two has merged meanwhile
            j = after[i]
            symbol[i] = new = made[rank]
            symbol[j] = ranks[j] = ranks[i] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                ranks[i] = rank = rank_of(new * size + symbol[k], -1)
                if rank >= 0:
                    heapq.heappush(queue, rank << _BITS | i)
            h = before[i]
            if h >= 0:
                ranks[h] = rank = rank_of(symbol[h] * size + new, -1)
                if rank >= 0:
                    heapq.heappush(queue, rank << _BITS | h)
        return [x for x in symbol if x >= 0]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is a special token) in order."""
        at = 0
        for m in self.cut.finditer(text):
            yield text[at:m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def split_up(self, piece: str) -> list[str]:
        """Normalise and split; white space is no part of any token, so its runs need no replacing."""
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            # lower case is taken letter by letter, without the final-sigma rule
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            return self.split.findall(piece.translate(LOWER) if _CASED.search(piece) else piece)
        return self.split_latin.findall(piece.lower())


class Remembered(dict):
    """The latest answers of a function of a string, in two generations of bounded size."""

    def __init__(self, answer: Callable[[str], tuple], size: int, longest: int = 64):
        super().__init__()
        self.answer, self.size, self.longest = answer, size, longest
        self.older: dict[str, tuple] = {}

    def __missing__(self, key: str) -> tuple:
        found = self.older.get(key)
        if found is None:
            found = self.answer(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Encodes texts with one vocabulary; ``packed`` gives ids as bytes and the decoded text.

    Neither the pattern's parts nor the special tokens hold white space, so the
    runs between white space are encoded one by one.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.parts = Remembered(self._part, _REMEMBERED)
        self.runs = Remembered(self._run, _REMEMBERED)

    def _pack(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.vocabulary.strings.__getitem__, ids))

    def _part(self, part: str) -> tuple[bytes, str]:
        return self._pack(self.vocabulary.merge(part))

    def _run(self, run: str) -> tuple[bytes, str]:
        vocabulary, out = self.vocabulary, []
        for piece, special in vocabulary.parts(run):
            if special:
                out.append(self._pack([vocabulary.special[piece]]))
            else:
                out += map(self.parts.__getitem__, vocabulary.split_up(piece))
        return out[0] if len(out) == 1 else (b"".join([x[0] for x in out]), " ".join([x[1] for x in out]))

    def packed(self, text: str | None) -> tuple[bytes, str]:
        text = text or ""
        # str.split() also splits at the control codes 1C-1F, which are no white space here
        runs = _NO_SPACE.findall(text) if _CONTROL.search(text) else text.split()
        out = list(map(self.runs.__getitem__, runs))
        return b"".join([x[0] for x in out]), " ".join([x[1] for x in out])

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.vocabulary.strings.__getitem__, ids))


def load(path: str) -> str:
    """The vocabulary file's text, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _apply(docs: DataFrame, path: str, text: str, keep: tuple[str, ...], fields: list[T.StructField],
           columns: Callable[[list[tuple[bytes, str]]], list[pa.Array]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(json.loads(shared.value)))
        for batch in batches:
            found = [encoder.packed(t) for t in batch["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], *columns(found)], ["row", *(f.name for f in fields)])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *fields]))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """The ``keep`` columns as a struct ``row``, with the ids and the decoded text of ``text``."""
    return _apply(docs, path, text, keep,
                  [T.StructField("ids", T.ArrayType(T.LongType(), False)), T.StructField("decoded", T.StringType())],
                  lambda found: [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x, _ in found],
                                          pa.list_(pa.int64())),
                                 pa.array([s for _, s in found], pa.string())])


_DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType())]


def _digests(found: list[tuple[bytes, str]]) -> list[pa.Array]:
    return [pa.array([len(x) // 4 for x, _ in found], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x, _ in found], pa.string()),
            pa.array([hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for _, s in found], pa.string())]


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """As ``encode``, with the number of ids and the SHA-256 of ids and decoded text in their place."""
    return _apply(docs, path, text, keep, _DIGESTS, _digests)


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with n_tokens, the digests and the ids themselves."""
    ids = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    found = _apply(docs, path, text, keep, [*_DIGESTS, ids],
                   lambda found: [*_digests(found),
                                  pa.array([np.frombuffer(x, "<i4") for x, _ in found], pa.list_(pa.int32()))])
    return found.select("row.*", *(f.name for f in _DIGESTS), "ids")
