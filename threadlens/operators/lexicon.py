"""Lexicon category counting: tokens matched against exact and prefix patterns.

A pattern is a word (``the``) or a stem with a trailing ``*`` (``th*``). A
token takes the categories of the shortest stem that is a prefix of it; only
if no stem matches does an exact word apply. We first drop every pattern
that can never win (a longer stem under a shorter one, a word under a stem);
after that a token matches at most one surviving pattern, so matching is a
plain equi-join of each token's candidate keys (its prefixes up to the
longest stem, and the token itself) against the broadcast pattern table.
No nested-loop join, no per-token regrouping.

``lexicon_array`` computes the same vector inside the row, for streams and for
plans that should have no exchange: the surviving patterns of a category are
written as one prefix tree in regular-expression form, tried only where a token
starts, so a token is left after its first character that no pattern has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import LEXICON_CHAR_SPARK as LEXICON_CHAR
from ..functions.text import lexicon_tokens
from .util import as_col, broadcast_if_bounded


@dataclass
class Lexicon:
    """Effective patterns plus the ordered category list (small, bounded)."""

    patterns: DataFrame          # key string, wild boolean, category string, ord int
    categories: list[str]        # in dictionary order
    stem_lengths: list[int]      # distinct lengths of surviving stems
    n_patterns: int

    @property
    def width(self) -> int:
        return len(self.categories)


def pattern_table(raw: DataFrame) -> DataFrame:
    """(pattern, category) -> (key, wild, category)."""
    wild = F.col("pattern").endswith("*")
    return raw.select(
        F.when(wild, F.expr("substring(pattern, 1, length(pattern) - 1)"))
        .otherwise(F.col("pattern")).alias("key"),
        wild.alias("wild"), F.col("category")).distinct()


def effective_patterns(pats: DataFrame, n_patterns: int) -> DataFrame:
    """Drop patterns shadowed by a shorter (or equal, for words) stem."""
    stems = broadcast_if_bounded(
        pats.filter("wild").select(F.col("key").alias("stem")).distinct(), n_patterns)
    pre = (pats.select("key", "wild").distinct()
           .select("key", "wild", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
           .select("key", "wild", "n", F.expr("substring(key, 1, n)").alias("prefix")))
    shadowed = (pre.join(stems, pre.prefix == stems.stem)
                .filter((~F.col("wild") & (F.col("n") <= F.length("key")))
                        | (F.col("wild") & (F.col("n") < F.length("key"))))
                .select("key", "wild").distinct())
    return pats.join(shadowed, ["key", "wild"], "left_anti")


def build_lexicon(raw: DataFrame, categories: list[str] | None = None) -> Lexicon:
    """Prepare a lexicon from a (pattern, category) table.

    ``categories`` fixes the vector order (dictionary order); by default the
    sorted distinct categories. The dictionary is small and bounded, so its
    metadata is collected once here.
    """
    n_raw = raw.count()
    eff = effective_patterns(pattern_table(raw), n_raw)
    if categories is None:
        categories = sorted(r[0] for r in raw.select("category").distinct().collect())
    ords = raw.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(categories)], "category string, ord int")
    eff = eff.join(broadcast_if_bounded(ords, len(categories)), "category") \
        .select("key", "wild", "category", "ord")
    # The surviving patterns are bounded by the dictionary: keep them as a
    # small local table so data plans carry no dictionary sub-plan.
    rows = eff.collect()
    table = raw.sparkSession.createDataFrame(
        rows, "key string, wild boolean, category string, ord int")
    lens = sorted({len(r["key"]) for r in rows if r["wild"]})
    return Lexicon(table, list(categories), lens, len(rows))


def lexicon_from_pairs(spark: SparkSession, pairs, categories=None) -> Lexicon:
    raw = spark.createDataFrame(list(pairs), "pattern string, category string")
    return build_lexicon(raw, categories)


def _candidates(tok: Column, stem_lengths: list[int]) -> Column:
    """Keys a token can match: itself, and its prefixes of stem lengths; null where it is shorter (or the empty sentinel)."""
    def stem(n: int) -> Column:
        return F.when((F.length(tok) >= n) & (tok != ""), F.substring(tok, 1, n))
    return F.array(F.struct(tok.alias("key"), F.lit(False).alias("wild")),
                   *[F.struct(stem(n).alias("key"), F.lit(True).alias("wild")) for n in stem_lengths])


def match_tokens(df: DataFrame, tok_col: str, lex: Lexicon) -> DataFrame:
    """Add ``category``/``ord`` to rows holding a token (one row per category)."""
    cols = list(df.columns)
    cands = df.select(*cols, F.explode(_candidates(F.col(tok_col), lex.stem_lengths)).alias("_c"))
    cands = cands.select(*cols, F.col("_c.key").alias("_key"), F.col("_c.wild").alias("_wild"))
    pats = broadcast_if_bounded(
        lex.patterns.select(F.col("key").alias("_key"), F.col("wild").alias("_wild"),
                            "category", "ord"), lex.n_patterns)
    return cands.join(pats, ["_key", "_wild"]).select(*cols, "category", "ord")


#: A key that no pattern has: it may hold no space.
_SENTINEL = " "


def _matching(lex: Lexicon) -> DataFrame:
    """(_key, wild, category, ord) of the patterns that can equal or start a token; a key is a word or a stem, never both."""
    # a key with any other character equals or starts no token; nor does the empty word
    some = F.col("key").rlike(rf"\A(?:{LEXICON_CHAR})*\z") & (F.col("wild") | (F.col("key") != ""))
    return lex.patterns.filter(some).select(F.col("key").alias("_key"), "wild", "category", "ord")


def found_keys(text: Column | str, lex: Lexicon) -> Column:
    """The word or stem that each token of a text matches, once a token; tokens that match none leave nothing."""
    every, _ = category_patterns(lex)
    found = F.array().cast("array<string>") if every is None else F.regexp_extract_all(
        F.lower(F.coalesce(as_col(text), F.lit(""))), F.lit(every), 0)
    if 0 in lex.stem_lengths:  # the empty stem, which every token has besides
        found = F.concat(found, F.array_repeat(F.lit(""), F.size(lexicon_tokens(as_col(text)))))
    return found


def lexicon_counts(df: DataFrame, id_col: str, text_col: Column | str, lex: Lexicon) -> DataFrame:
    """Long form: (id, category, n) for categories that occur."""
    ex = df.select(id_col, F.explode(found_keys(text_col, lex)).alias("_key"))
    pats = broadcast_if_bounded(_matching(lex).select("_key", "category"), lex.n_patterns)
    m = ex.join(pats, "_key")
    return m.groupBy(id_col, "category").agg(F.count(F.lit(1)).alias("n"))


def lexicon_vector(df: DataFrame, id_col: str, text_col: Column | str, lex: Lexicon,
                   carry: tuple[str, ...] = (), out: str = "lex_vec") -> DataFrame:
    """Zero-filled ``array<long>`` of category counts in dictionary order.

    The keys that a text's tokens match are found in one scan of it, exploded,
    and joined to the patterns for their categories. Each text also carries one
    sentinel key (a space, never in a matching key) that matches a sentinel row, so texts without any match - empty
    and null ones included - still reach the aggregate and get all zeros.
    One shuffle on the id, after a map-side partial aggregate.
    """
    keys = F.concat(F.array(F.lit(_SENTINEL)), found_keys(text_col, lex))
    ex = df.select(id_col, *carry, F.explode(keys).alias("_key"))
    marker = df.sparkSession.createDataFrame([(_SENTINEL, False, None, -1)], "_key string, wild boolean, category string, ord int")
    pats = broadcast_if_bounded(_matching(lex).unionByName(marker), lex.n_patterns + 1)
    m = ex.join(pats, "_key")
    sums = [F.sum(F.when(F.col("ord") == i, 1).otherwise(0)).cast("long").alias(f"_c{i}")
            for i in range(lex.width)]
    g = m.groupBy(id_col, *carry).agg(*sums)
    return g.select(id_col, *carry, F.array(*[F.col(f"_c{i}") for i in range(lex.width)]).alias(out))


def _prefix_tree(keys: list[tuple[str, bool]]) -> str:
    """A regular expression for one token's start that matches if a word or stem (key, wild) does."""
    tree: dict = {}
    for key, wild in keys:
        node = tree
        for ch in key:
            node = node.setdefault(ch, {})
        node[wild] = True

    def written(node: dict) -> str:
        if True in node:  # a stem: whatever follows
            return ""
        ways = [f"\\x{{{ord(ch):x}}}{written(after)}" for ch, after in sorted((k, v) for k, v in node.items()
                                                                             if isinstance(k, str))]
        if False in node:  # a word: the token ends here
            ways.append(f"(?!{LEXICON_CHAR})")
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return written(tree)


def _at_tokens(keys: list[tuple[str, bool]]) -> str:
    """A regular expression that matches once at each token's start if a word or stem does; most characters fail its first class."""
    first = "" if ("", True) in keys else f"(?=[{''.join(f'\\x{{{i:x}}}' for i in sorted({ord(k[0]) for k, _ in keys if k}))}])"
    return rf"{first}(?<!{LEXICON_CHAR})(?={LEXICON_CHAR}){_prefix_tree(keys)}"


def category_patterns(lex: Lexicon) -> tuple[str | None, list[str | None]]:
    """Regular expressions that match once at each token of any category (but the empty stem), and of each category; None without patterns."""
    rows = _matching(lex).select("_key", "ord", "wild").collect()
    keys: dict[int, list[tuple[str, bool]]] = {}
    for r in rows:
        keys.setdefault(r.ord, []).append((r._key, r.wild))
    every = [(r._key, r.wild) for r in rows if r._key]
    return (_at_tokens(every) if every else None,
            [_at_tokens(keys[i]) if i in keys else None for i in range(lex.width)])


def lexicon_array(text: Column | str, lex: Lexicon) -> Column:
    """``lexicon_vector`` of one text, as a projection.

    A text is scanned once, for the words and stems of all categories; what is found, a small part of it, once a category.
    """
    every, own = category_patterns(lex)
    found = F.lower(F.coalesce(as_col(text), F.lit("")))
    if every is not None and 0 not in lex.stem_lengths:  # the empty stem, which every token has, leaves nothing to search again
        found = F.array_join(F.regexp_extract_all(found, F.lit(every), 0), " ")

    def counts(keys: Column) -> Column:
        return F.array(*[F.lit(0).cast("long") if p is None else F.regexp_count(keys, F.lit(p)).cast("long") for p in own])

    # one element, so that what is found is a variable and is computed once
    return F.element_at(F.transform(F.array(found), counts), 1)


def save_lexicon(lex: Lexicon, path: str) -> str:
    """The categories in order and the effective patterns, as two tables."""
    spark = lex.patterns.sparkSession
    spark.createDataFrame([(c, i) for i, c in enumerate(lex.categories)], "category string, ord int") \
        .write.mode("overwrite").parquet(f"{path}/categories")
    lex.patterns.write.mode("overwrite").parquet(f"{path}/patterns")
    return path


def load_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """A saved lexicon; a dictionary is small, so its tables are read to the driver."""
    categories = [r.category for r in spark.read.parquet(f"{path}/categories").orderBy("ord").collect()]
    rows = spark.read.parquet(f"{path}/patterns").select("key", "wild", "category", "ord").collect()
    table = spark.createDataFrame(rows, "key string, wild boolean, category string, ord int")
    return Lexicon(table, categories, sorted({len(r["key"]) for r in rows if r["wild"]}), len(rows))
