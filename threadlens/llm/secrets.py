"""Secret scans: fixed patterns, and guess costs of values in a credential context.

Three patterns find base spans (``assign``, ``access``, ``hex``). Beyond them,
a value that stands where a credential would (after a credential word and a
colon, an equals sign or "is", after "bearer" and a blank if it looks like a
token, or before the @ of a URL) is reported as
``guess`` if guessing it is costly enough: a dynamic programme over the value's
positions finds the cheapest segmentation into dictionary words, dates,
repeats, keyboard walks and brute-force spans, in log10 of guesses, with one
factor of ``SEGMENT`` for each further segment. A memorable phrase is cheap; a
generated password is not. The dictionary is the list of whole words of a public
vocabulary, whose order is that of their frequency.

Spans are code points, end exclusive, ordered by start and then by kind as in
``KINDS``. A value ends at its closing quote; without quotes at the next blank, at
the quote of a string around it, or at a ``;``, ``&`` or comma before a further field
(a name with the sign that stands before the value, or a credential word with
either); other punctuation may be part of it. A value is priced whole, also where base spans hold a part of it; its
``guess`` span is added if it reaches beyond all other spans, which stay.

Defined results: a null text counts as empty and has no spans; repeated rows and
null ids are scanned like any others.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")

# The base patterns, and the least length of the group that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16

_CREDENTIAL = r"(?:pwd|pass(?:word|wd|phrase|code)?|secret|token|api_?key|credentials?|auth|bearer" \
    r"|private_?key|access_?key|client_?secret)"
#: What follows "bearer" as a token: 16 characters or more with a digit, so no plain word.
_TOKEN = r"(?=[A-Za-z0-9._~+/-]{16})(?=[A-Za-z._~+/-]*[0-9])"
#: Up to the value. Groups: the sign before it (none for "is" and a blank), and the quote that opens it.
CONTEXT = re.compile(rf"""(?<![A-Za-z0-9]){_CREDENTIAL}"""
                     rf"""(?:["']?\x20{{0,8}}([:=])|\x20{{1,8}}is(?=\x20)|(?<=bearer)\x20{{1,8}}{_TOKEN})"""
                     r"""\x20{0,8}(["']?)(?=[!-~])""", re.IGNORECASE | re.ASCII)
#: A value and its closing quote; a backslash keeps the character after it from closing.
QUOTED = {'"': re.compile(r'(?:[!#-\[\]-~]|\\[!-~])*+"'), "'": re.compile(r"(?:[!-&(-\[\]-~]|\\[!-~])*+'")}


def _ends(name: str) -> re.Pattern:
    """Ends of values without quotes: a blank, a further field, the quote (group 1) of a string around them."""
    return re.compile(rf"""[^!-~]|[}}\])"']{{0,4}}[;&,][{{\["']{{0,4}}(?:{_CREDENTIAL}["']?[:=]{name})"""
                      r"""|(["'])(?=[}\]),;:>]|[^!-~]|\Z)""", re.IGNORECASE | re.ASCII)


#: By the sign before the value, as fields of one record have the same.
ENDS = {sign: _ends(rf"""|[A-Z_][A-Z0-9_.-]{{0,63}}["']?{sign}""" if sign else "") for sign in (":", "=", None)}
#: The string around a value opens at most so many characters before the credential word.
AROUND = 256
USERINFO = re.compile(r"://[^\s/:@]{1,256}:([^\s/@]+)@", re.ASCII)
MIN_VALUE = 6
#: What is left of a value beyond other spans does not count if it is these alone.
CLOSERS = "\"'.,;:!?)]}>"
#: Values that cost at least so much to guess (log10) are reported.
MIN_GUESSES = 9.0
#: Texts without any of these hold no span of any kind.
HINT = r"(?i:pass|pwd|secret|token|api_?key|credential|auth|bearer|private_?key|access_?key)|AKIA|[0-9a-f]{32}|://"

SEGMENT = math.log10(4)
MAX_WORD = 24
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LEET = str.maketrans("@4301!$57", "aaeoiisst")
#: Groups: first number, separator, second and third number.
DATE = re.compile(r"(\d{1,4})([-/._ ])(\d{1,2})\2(\d{1,4})", re.ASCII)
#: Digits of the first and second number of a date without separators, by its length.
DATE_SPLITS = {6: [(2, 2)], 8: [(4, 2), (2, 2)]}
YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)


def keyboard() -> dict[str, set[str]]:
    """Neighbours of each key: beside it, and the nearest two in the rows above and below."""
    place = {key: (row, at) for row, keys in enumerate(ROWS) for at, key in enumerate(keys) if key != " "}
    near: dict[str, set[str]] = {}
    for key, (row, at) in place.items():
        near[key] = {k for k, (r, a) in place.items()
                     if (r == row and abs(a - at) == 1) or (r == row + 1 and a - at in (-1, 0))
                     or (r == row - 1 and a - at in (0, 1))}
    return near


class GuessCost:
    """log10 of the guesses that the cheapest segmentation of a value needs."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.near = keyboard()

    @staticmethod
    def _alphabet(c: str) -> float:
        if c.isdigit():
            return 1.0
        return math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0

    def _word(self, part: str) -> float | None:
        low = part.lower()
        rank, extra = self.words.get(low), 0.0
        if rank is None:
            rank, extra = self.words.get(low.translate(LEET)), math.log10(2)
            if rank is None:
                return None
        upper = sum(c.isupper() for c in part)
        if upper:
            plain = part[:1].isupper() and upper == 1 or part.isupper()
            extra += math.log10(2) if plain else math.log10(math.comb(len(part), upper) + 1)
        return math.log10(rank + 1) + extra

    @staticmethod
    def _date(part: str) -> float | None:
        """Price of the cheapest reading of ``part`` as a date: two-digit years, or four-digit ones at either end."""
        if (m := DATE.fullmatch(part)):
            readings, extra = [(m[1], m[3], m[4])], math.log10(4)
        elif part.isascii() and part.isdigit():
            readings, extra = [(part[:a], part[a:a + b], part[a + b:]) for a, b in DATE_SPLITS.get(len(part), [])], 0.0
        else:
            return None
        prices = []
        for a, b, c in readings:
            year, days = (a, (b, c)) if len(a) == 4 else (c, (a, b))
            if len(year) in (2, 4) and all(len(x) <= 2 and 1 <= int(x) <= 31 for x in days) and min(map(int, days)) <= 12:
                prices.append(math.log10(365 * (max(abs(int(year) - 2000), 20) if len(year) == 4 else 100)) + extra)
        return min(prices, default=None)

    def __call__(self, value: str) -> float:
        n = len(value)
        best = [0.0] + [math.inf] * n

        def offer(i: int, j: int, price: float) -> None:
            price += best[i] + (SEGMENT if i else 0.0)
            if price < best[j]:
                best[j] = price

        keys = value.lower().translate(SHIFTED)
        walk = [0] * n  # steps of the keyboard walk from each position
        for i in range(n - 2, -1, -1):
            walk[i] = walk[i + 1] + 1 if keys[i + 1] in self.near.get(keys[i], ()) else 0
        open_cost = math.inf  # of the cheapest way to end a brute-force span here
        for i in range(n):
            # a brute-force span is extended by one character, or opened here
            open_cost = min(open_cost, best[i] + (SEGMENT if i else 0.0)) + self._alphabet(value[i])
            for j in range(i + 3, min(n, i + MAX_WORD) + 1):
                if (price := self._word(value[i:j])) is not None:
                    offer(i, j, price)
            if (m := YEAR.match(value, i)):
                offer(i, m.end(), math.log10(max(abs(int(m[0]) - 2000), 20)))
            for width in (6, 7, 8, 9, 10) if value[i].isdigit() else ():
                if i + width <= n and (price := self._date(value[i:i + width])) is not None:
                    offer(i, i + width, price)
            if walk[i] >= 2 and (i == 0 or walk[i - 1] == 0):  # walks and repeats start where they may
                turns = 0.0
                for j in range(i + 2, i + walk[i] + 1):
                    # as long as the step is the same, a walk goes straight on
                    turns += (ord(keys[j]) - ord(keys[j - 1])) != (ord(keys[j - 1]) - ord(keys[j - 2]))
                    offer(i, j + 1, math.log10(47) + math.log10(4.6) * (turns + 1) / 2 + math.log10(j + 1 - i))
            for width in (1, 2, 3, 4):
                unit = value[i:i + width]
                starts = i == 0 or i + width > n or value[i - 1] != value[i - 1 + width]
                if starts and len(unit) == width and value.startswith(unit, i + width):
                    j = i + 2 * width
                    while value.startswith(unit, j):
                        j += width
                    if j - i >= 3:
                        offer(i, j, sum(map(self._alphabet, unit)) + math.log10((j - i) // width))
            if open_cost < best[i + 1]:
                best[i + 1] = open_cost
        return best[n]


def words_of(definition: str) -> dict[str, int]:
    """Whole words of a word-end vocabulary with their rank."""
    end = (model := json.loads(definition)["model"])["end_of_word_suffix"]
    whole = [s[:-len(end)] for s in sorted(model["vocab"], key=model["vocab"].get) if s.endswith(end)]
    return {w: i for i, w in enumerate(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())}


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans in order of start as (start, end), those that touch as one."""
    out: list[tuple[int, int]] = []
    for _, start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _end_of(held: list[tuple[int, int]], at: int) -> int:
    """Where the span that holds ``at`` ends; ``at`` itself if none does."""
    i = bisect_right(held, (at, math.inf)) - 1
    return max(at, held[i][1]) if i >= 0 else at


def _value_end(text: str, m: re.Match) -> tuple[int, bool]:
    """Where the value of a context ends, and whether a quote closes it."""
    if m[2] and (quoted := QUOTED[m[2]].match(text, m.end())):
        return quoted.end() - 1, True
    for end in ENDS[m[1]].finditer(text, m.end()):
        if not end[1] or end[1] in text[max(0, m.start() - AROUND):m.start()]:
            return end.start(), False
    return len(text), False


class Scanner:
    def __init__(self, words: dict[str, int]):
        self.cost = GuessCost(words)

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        found, reach = [], 0
        held = _merged(base)
        contexts = list(CONTEXT.finditer(text))
        # within a run of one repeated context only the last two have a value of their own
        values = [(m.end(), m) for m, *more in zip(contexts, contexts[1:] + [None], contexts[2:] + [None, None])
                  if None in more or not (m[0] == more[0][0] == more[1][0] and m.end() == more[0].start()
                                          and more[0].end() == more[1].start())]
        values += [(m.start(1), m) for m in USERINFO.finditer(text)]
        for start, m in sorted(values, key=lambda v: v[0]):
            if m.re is CONTEXT and start < reach:
                continue
            end, closed = _value_end(text, m) if m.re is CONTEXT else (m.end(1), False)
            value = text[start:end] if closed else text[start:end].rstrip("\"'.,;:!?)")
            end = start + len(value)
            if len(value) < MIN_VALUE:
                continue
            # all up to ``reach`` is held by other spans; closers alone are no value
            if _end_of(held, max(start, reach)) >= (end if closed else start + len(value.rstrip(CLOSERS))):
                reach = max(reach, end)
                continue
            if self.cost(value) >= MIN_GUESSES:
                found.append(("guess", start, end))
                reach = max(reach, end)
        return found

    def scan(self, text: str) -> tuple[list, list]:
        """(base spans, all spans)."""
        base = self.base(text)
        return base, sorted(base + self.added(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("spans", SPANS), T.StructField("n_assign", T.LongType()),
          T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
          T.StructField("base_sha256", T.StringType()), T.StructField("written", T.StringType()),
          T.StructField("redacted", T.StringType())]


def scan(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("*",),
         with_text: bool = True) -> DataFrame:
    """The ``keep`` columns as a struct ``row``, with the spans of ``text``, their digest and counts.

    ``redacted`` is the text without its secrets (null for a null text, or if
    ``with_text`` is off). ``path`` names the vocabulary file.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(words_of(f.read()))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("body"))
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            body = batch["body"]
            hint = pc.match_substring_regex(body, HINT).to_pylist()
            found = [scanner.scan(t.as_py()) if h else ([], []) for t, h in zip(body, hint)]
            count = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS[:3]]
            clean = [redacted(t.as_py(), spans) if h and spans else t.as_py()
                     for t, h, (_, spans) in zip(body, hint, found)] if with_text else [None] * len(found)
            yield pa.RecordBatch.from_arrays(
                [batch["row"],
                 pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for _, x in found], spans_type),
                 *(pa.array(c, pa.int64()) for c in count),
                 pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                 pa.array([written(x) for _, x in found], pa.string()), pa.array(clean, pa.string())],
                ["row", *(f.name for f in FIELDS)])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *FIELDS]))


def redact(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with its text redacted, and n_chars, where there is one, counted anew."""
    found = scan(docs, path)
    fresh = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
