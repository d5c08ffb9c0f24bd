"""Language identification by prediction by partial matching (PPM).

Every language gets a variable-order context tree over bytes: a node is a
context of 0 to ``ORDER`` bytes and holds how often each byte followed it.
Under the frozen counts the probability of a byte in a context that the
language has seen n times, with d different followers, one of them c times, is
c / (n + d); a byte that never followed it escapes with d / (n + d) to the
context one byte shorter, and at the end to the uniform order -1. Contexts that
the language has not seen are passed through at no cost. There is no exclusion,
so code lengths are those of a valid, slightly wasteful code.

The stream that is coded is the text's words: runs of letters, lower-cased,
each with one space before and behind. Contexts start at the space before a
word. So a word's code length depends on the word alone, a text's is the sum
over its words, and whole texts are scored with one table lookup a word.

The trees of all languages share one table (the union of their contexts), held
as sorted hashes with one column of costs a language. It is built from a
bounded sample of the labelled rows (``SAMPLE_DOCS``), so it may be broadcast.

Defined results: a text that is null or has no letter gets ``und`` and score 0;
with no learned language every text does. Ties between languages go to the
language that sorts first. Repeated rows are scored alike; a null id stays null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 4
#: Bound of the training sample, in documents over all languages.
SAMPLE_DOCS = 2000
#: Labels are a closed set; a column with more values is not a language label.
MAX_LANGUAGES = 1000
#: The pipeline rejects texts coded worse than this, in bits a byte, in every language.
REJECT_BITS = 7.0
UND = "und"

_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[A-Za-z]")
_CACHE_WORDS = 150_000
_CACHE_LENGTH = 48
_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _stream(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of `` word `` after ``word ``, each position's word and its place in it."""
    coded = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
    data = np.frombuffer(b"".join(coded), np.uint8)
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    word = np.repeat(np.arange(len(coded)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return data, word, place


def _scramble(x: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(order * 0x51ED27)) * _MIX
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class ContextTrees:
    """Frozen context trees of all languages, with costs in bits."""

    def __init__(self, languages: list[str], pairs: list | None = None, escapes: list | None = None):
        self.languages = languages
        # per order: sorted hashes, and a row of costs for each with a column a language
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = pairs or []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = escapes or []

    @staticmethod
    def _contexts(data: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that have ``order`` bytes before them in their word, and those bytes packed."""
        at = np.flatnonzero(place >= max(order, 1))
        packed = np.zeros(len(at), np.uint64)
        for back in range(order, 0, -1):
            packed = (packed << np.uint64(8)) | data[at - back]
        return at, packed

    @classmethod
    def fit(cls, counts: Iterable[tuple[str, str, int]]) -> ContextTrees:
        """From (language, word, count) rows."""
        rows = [r for r in counts if r[1]]
        trees = cls(sorted({r[0] for r in rows}))
        if not rows:
            return trees
        column = {x: i for i, x in enumerate(trees.languages)}
        n_lang = len(trees.languages)
        data, word, place = _stream([r[1] for r in rows])
        lang = np.array([column[r[0]] for r in rows])[word]
        weight = np.array([r[2] for r in rows], float)[word]
        # probabilities are filled from the shortest order up; unseen followers of a
        # longer context cost its escape plus the shorter context's price
        for order in range(ORDER + 1):
            at, packed = cls._contexts(data, place, order)
            context, where = np.unique(packed, return_inverse=True)
            follow = (where.astype(np.uint64) << np.uint64(8)) | data[at]
            pair, pair_at = np.unique(follow, return_inverse=True)
            c = np.zeros((len(pair), n_lang))
            np.add.at(c, (pair_at, lang[at]), weight[at])
            of = (pair >> np.uint64(8)).astype(np.int64)
            n = np.zeros((len(context), n_lang))
            d = np.zeros((len(context), n_lang))
            np.add.at(n, of, c)
            np.add.at(d, of, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, np.log2((n + d) / d), 0.0)
                own = np.where(c > 0, np.log2((n + d)[of] / c), np.inf)
            byte = (pair & np.uint64(255)).astype(np.uint8)
            if order == 0:
                shorter = np.full((len(pair), n_lang), 8.0)
            else:
                tail = context[of] & np.uint64((1 << (8 * (order - 1))) - 1)
                shorter = trees._price(tail, byte, order - 1)
            price = np.where(c > 0, own, escape[of] + shorter)
            key = _scramble(context[of] << np.uint64(8) | byte, order)
            sort = np.argsort(key)
            trees.pairs.append((key[sort], price[sort].astype(np.float32)))
            key = _scramble(context, order)
            sort = np.argsort(key)
            trees.escapes.append((key[sort], escape[sort].astype(np.float32)))
        return trees

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.searchsorted(keys, wanted)
        spot[spot == len(keys)] = 0
        return spot, keys[spot] == wanted

    def _price(self, packed: np.ndarray, byte: np.ndarray, order: int) -> np.ndarray:
        """Bits a language for each (context of ``order`` bytes, next byte)."""
        out = np.zeros((len(packed), len(self.languages)), np.float32)
        left = np.arange(len(packed))
        while order >= 0 and len(left):
            keys, price = self.pairs[order]
            spot, hit = self._find(keys, _scramble(packed << np.uint64(8) | byte, order))
            out[left[hit]] += price[spot[hit]]
            left, packed, byte = left[~hit], packed[~hit], byte[~hit]
            keys, escape = self.escapes[order]
            spot, hit = self._find(keys, _scramble(packed, order))
            out[left[hit]] += escape[spot[hit]]
            order -= 1
            packed = packed & np.uint64((1 << (8 * max(order, 0))) - 1)
        out[left] += 8.0
        return out

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each language, as an array (words, languages)."""
        out = np.zeros((len(words), len(self.languages)))
        for lo in range(0, len(words), 20_000):
            data, word, place = _stream(words[lo:lo + 20_000])
            for order in range(ORDER + 1):  # the longest context that the place allows
                at, packed = self._contexts(data, place, order)
                exact = (place[at] == order) if order < ORDER else (place[at] >= ORDER)
                exact &= place[at] > 0
                if exact.any():
                    at = at[exact]
                    price = self._price(packed[exact], data[at], order)
                    n = min(20_000, len(words) - lo)
                    for i in range(price.shape[1]):
                        out[lo:lo + n, i] += np.bincount(word[at], price[:, i], n)
        return out


class Scorer:
    """Scores texts, remembering the code lengths of short words."""

    def __init__(self, trees: ContextTrees):
        self.trees = trees
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(trees.languages)))
        self.coded = np.zeros(0)  # bytes of each known word: its own, and the space behind it

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code length in bits a language, bytes coded) of each text."""
        if len(self.known) > _CACHE_WORDS:
            self.known, self.table, self.coded = {}, self.table[:0], self.coded[:0]
        known, fresh, ids = self.known, [], []
        n_known = len(known)
        for text in texts:
            words = words_of(text)
            # repeats within one call share an entry, long words too
            for w in set(words).difference(known):
                known[w] = n_known + len(fresh)
                fresh.append(w)
            ids.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if fresh:
            self.table = np.concatenate([self.table, self.trees.code_lengths(fresh)])
            self.coded = np.concatenate([self.coded, [len(w.encode("utf-8", "surrogatepass")) + 1.0 for w in fresh]])
        bits = np.array([self.table[i].sum(axis=0) for i in ids]).reshape(len(texts), -1)
        size = np.array([self.coded[i].sum() for i in ids], float)
        if any(len(w) > _CACHE_LENGTH for w in fresh):  # long words are not kept
            self.known, self.table, self.coded = {}, self.table[:0], self.coded[:0]
        return bits, size

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, posterior probability, bits a byte) of each text."""
        full = [t or "" for t in texts]
        languages = self.trees.languages
        if not languages:
            return [(UND, 0.0, 8.0)] * len(full)
        bits, size = self.totals(full)
        best = bits.argmin(axis=1)
        lead = bits.min(axis=1)
        score = 1.0 / np.exp2(np.clip(lead[:, None] - bits, -1000, 0)).sum(axis=1)
        rate = lead / np.maximum(size, 1)
        return [(languages[b], float(s), float(r)) if has_letter(t) else (UND, 0.0, 8.0)
                for t, b, s, r in zip(full, best, score, rate)]


def sample(labelled: DataFrame, lang: str = "lang", text: str = "text", bound: int = SAMPLE_DOCS,
           key: str = "doc_id") -> DataFrame:
    """At most about ``bound`` rows, the same number of each language, picked by a hash of the row.

    The hash is of ``key`` (if there is such a column) and ``text``, so copies of a
    text under several ids are drawn one by one.
    """
    counts = labelled.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang!r}")
    if not counts:
        return labelled
    share = bound / len(counts)
    cut = F.lit(0.0)
    for r in counts:
        cut = F.when(F.col(lang) == r[lang], F.lit(min(1.0, share / r["count"]))).otherwise(cut)
    of = [F.col(c) for c in (key, text) if c in labelled.columns]
    draw = F.pmod(F.xxhash64(*of, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(draw < cut)


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", bound: int = SAMPLE_DOCS,
        key: str = "doc_id") -> ContextTrees:
    """Learn the context trees of the languages of the labelled rows with a letter."""
    keys = [F.col(key).alias("key")] if key in labelled.columns else []
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), *keys) \
        .filter("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for name, body in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if has_letter(body):
                    seen.setdefault(name, Counter()).update(words_of(body))
            for name, counter in seen.items():
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(counter), "word": list(counter),
                                                  "n": list(counter.values())})

    # one worker's words of a language are counted before the shuffle
    words = sample(rows, bound=bound, key="key").mapInArrow(count, "lang string, word string, n long") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return ContextTrees.fit((r.lang, r.word, r.n) for r in words.collect())


def predict(docs: DataFrame, trees: ContextTrees, text: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """The ``keep`` columns as one struct ``row``, with lang_pred, score and bits_per_byte beside it."""
    shared = docs.sparkSession.sparkContext.broadcast((trees.languages, trees.pairs, trees.escapes))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("body"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ContextTrees(*shared.value))
        for batch in batches:
            found = scorer.predict(batch["body"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())],
                ["row", "lang_pred", "score", "bits_per_byte"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def identified(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a language that their labels teach.

    Rejected are texts without a letter, and texts that every language codes
    in more than ``REJECT_BITS`` bits a byte. Without labels only the former are.
    """
    trees = fit(docs, lang, text)
    if not trees.languages:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    return predict(docs, trees, text).filter((F.col("lang_pred") != UND) & (F.col("bits_per_byte") <= REJECT_BITS)) \
        .select("row.*")
