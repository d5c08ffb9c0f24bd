"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule is a ratio of counts of a text; a document is rejected by a rule if
its ratio exceeds the cutoff of its stratum. Cutoffs come from a fixed grid and
from labelled documents, in two steps on different documents:

1. A third of the holdout, by a hash of the key, orders the candidates. For each
   tolerance of ``TOLERANCES`` a stratum gets a rule set: of each rule, the cutoffs
   that cost at most that share of its good documents and reject a greater share of
   the bad ones; of those, the one that rejects most bad documents (the loosest
   among equals). So each rule set rejects all that the one before it rejects.
2. The rest tests the rule sets of a stratum, each as a whole. With n good documents
   of which a set rejects k, it is valid if the exact binomial tail
   P(Binomial(n, ``ALPHA``) <= k) is at most ``DELTA`` / strata: the one-sided
   Clopper-Pearson bound on the false rejection rate, Bonferroni-corrected over
   strata. Sets are tested in their order up to the first that fails (fixed-sequence
   testing, which needs no correction within a stratum).

So with confidence 1 - DELTA no stratum loses more than ALPHA of its good
documents, by all its rules together. Of the valid sets the one that parts bad from
good test documents best is taken (the loosest among equals). A stratum without a
valid set that helps rejects nothing.

A set that rejects no good document is valid from log(DELTA / strata) / log(1 - ALPHA)
good test documents on: 59 with one stratum, 86 with four, 104 with ten. Strata with
fewer than the 59 cannot pass whatever their rows say, are not tested, and do not
count in the correction.

Holdout documents are the labelled ones that pass the base rules. A document
with several labels counts as good only if all its labels say so. Strata are the
values of a column (null is one of them); the cutoffs of up to ``MAX_STRATA`` are
broadcast, more are joined as a table.

Defined results: a null text counts as empty and fails the base rules; null ids
and repeated rows are judged like any others; without labels the base rules
alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SEPARATORS, save

#: Share of good documents that a stratum may lose to the rules, and the chance that it loses more.
ALPHA = 0.05
DELTA = 0.05
#: Shares of good ordering documents that a rule may cost, one rule set each, in rising order.
TOLERANCES = [0.0, 0.001, 0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05]
#: One of so many holdout documents orders the rule sets; the others test them.
ORDERING = 3
MAX_STRATA = 1000
MIN_WORDS = 50
SHARES = [0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9]
#: Rules: numerator, denominator, grid of cutoffs in rising order.
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "word_chars", SHARES),
    "dup_lines": ("n_dup_lines", "n_lines", SHARES),
    "repeats": ("n_repeat_words", "n_words", SHARES[:-3]),
    "capitals": ("n_capital_words", "n_words", SHARES),
    "long_words": ("word_chars", "n_words", [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0]),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capital_words")


def words_of(text: Column) -> Column:
    """Words of a text: any of the six separators becomes a space, runs of spaces are dropped."""
    others = SEPARATORS.replace(" ", "")
    return F.array_remove(F.split(F.translate(text, others, " " * len(others)), " "), "")


def _same(words: Column, a: Column, b: Column) -> Column:
    """Whether two windows of three words, as (hash, start), are equal."""
    equal = a["h"] == b["h"]
    for k in range(3):
        equal = equal & (F.get(words, a["at"] + k) == F.get(words, b["at"] + k))
    return F.coalesce(equal, F.lit(False))


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """The ``keep`` columns as a struct ``row``, and the counts the rules use.

    Equal three-word windows are neighbours once the windows are sorted by hash;
    their words are compared as well. Sorted starts of repeated windows give the
    words they cover: each adds the three words, less those of the one before.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # each step reads the arrays of the one before more than once, so they are kept apart
    rows = docs.select(F.struct(*keep).alias("row"), body.alias("body"), words_of(body).alias("w"),
                       F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        "row", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.rlike("^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"))).cast("long")
        .alias("n_capital_words"),
        F.sort_array(F.transform(
            F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("at"))))
        .alias("windows"))
    g, w = F.col("windows"), F.col("w")
    starts = F.transform(
        F.filter(g, lambda x, j: _same(w, x, F.get(g, j - 1)) | _same(w, x, F.get(g, j + 1))), lambda x: x["at"])
    covered = F.aggregate(
        F.sort_array(starts), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", covered).select("row", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact, in logarithms; 1 where k is at or beyond the mean."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] + F.log((n - j + 1) / j * odds)).alias("term"),
            (F.greatest(acc["sum"], acc["term"] + F.log((n - j + 1) / j * odds))
             + F.log1p(F.exp(-F.abs(acc["sum"] - acc["term"] - F.log((n - j + 1) / j * odds))))).alias("sum")),
        lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.when(k == 0, first).otherwise(total)))


def orders(key: Column) -> Column:
    """Whether a holdout document orders the rule sets (the others test them)."""
    return F.pmod(F.xxhash64(key, F.lit(10)), F.lit(ORDERING)) == 0


def rule_sets(ordering: DataFrame) -> DataFrame:
    """Per stratum and step (position in ``TOLERANCES``) one column a rule: its level (null: rejects nothing).

    ``ordering`` has stratum, good, level_<rule> and count.
    """
    reached = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"level_{r}").alias("reached")) for r in RULES])
    # a document that reaches a level exceeds that level's cutoff and all below it; level 0 counts the documents
    levels = ordering.select("stratum", "good", "count", F.inline(reached)) \
        .groupBy("stratum", "good", "rule", "reached").agg(F.sum("count").alias("count")) \
        .select("stratum", "rule", F.explode(F.sequence(F.lit(0), "reached")).alias("level"),
                F.when(F.col("good"), F.col("count")).otherwise(0).alias("k"),
                F.when(F.col("good"), 0).otherwise(F.col("count")).alias("bad")) \
        .groupBy("stratum", "rule", "level").agg(F.sum("k").alias("k"), F.sum("bad").alias("bad"))
    rule = Window.partitionBy("stratum", "rule")  # one row a level of the grid
    n, n_bad = (F.max(F.when(F.col("level") == 0, F.col(c))).over(rule) for c in ("k", "bad"))
    cost, caught = F.col("k") / F.greatest("n", F.lit(1)), F.col("bad") / F.greatest("n_bad", F.lit(1))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("tolerance")) for i, t in enumerate(TOLERANCES)])
    return levels.withColumns({"n": n, "n_bad": n_bad}).filter((F.col("level") > 0) & (caught > cost)) \
        .select("stratum", "rule", "level", "bad", cost.alias("cost"), F.inline(steps)).filter("cost <= tolerance") \
        .groupBy("stratum", "step").agg(*[
            F.max_by(F.when(F.col("rule") == r, F.col("level")),
                     F.when(F.col("rule") == r, F.struct("bad", "level"))).alias(f"set_{r}") for r in RULES])


def cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum one column a rule with its cutoff (null: none), from labelled rows.

    ``holdout`` has stratum, good and orders (booleans), and the counts.
    """
    def level(rule: str) -> Column:
        """How many of the rule's cutoffs a document exceeds."""
        value = ratio(rule)
        return F.size(F.filter(F.array(*map(F.lit, RULES[rule][2])), lambda cutoff: value > cutoff))

    names = [f"level_{r}" for r in RULES]
    # documents of the same levels are one row from here on, so no stratum is hot
    rows = save(holdout.select("stratum", "good", "orders", *[level(r).alias(f"level_{r}") for r in RULES])
                .groupBy("stratum", "good", "orders", *names).count())
    tested = rows.filter("not orders")
    enough = tested.filter("good").groupBy("stratum").agg(F.sum("count").alias("n")) \
        .filter(F.pow(F.lit(1 - alpha), F.col("n")) <= delta)
    n_strata = max(1, enough.count())
    sets = rule_sets(rows.filter("orders")).withColumnRenamed("stratum", "of")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(f"level_{r}") >= F.col(f"set_{r}"), F.lit(False))

    def total(where: Column) -> Column:
        return F.sum(F.when(where, F.col("count")).otherwise(0))

    chosen = [f"set_{r}" for r in RULES]
    tests = tested.join(sets, tested["stratum"].eqNullSafe(sets["of"])).groupBy("stratum", "step", *chosen).agg(
        total(F.col("good")).alias("n"), total(F.col("good") & rejected).alias("k"),
        total(~F.col("good")).alias("n_bad"), total(~F.col("good") & rejected).alias("bad"))
    passes = binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta / n_strata)
    loosest_first = Window.partitionBy("stratum").orderBy("step")  # one row a step
    gain = F.col("bad") / F.greatest("n_bad", F.lit(1)) - F.col("k") / F.greatest("n", F.lit(1))
    best = tests.withColumn("passes", passes).withColumn("valid", F.min("passes").over(loosest_first)) \
        .filter("valid").withColumn("gain", gain).filter("gain > 0") \
        .groupBy("stratum").agg(F.max_by(F.struct(*chosen), F.struct("gain", -F.col("step"))).alias("best"))
    return best.select("stratum", *[
        F.get(F.array(*map(F.lit, RULES[r][2])), F.col(f"best.set_{r}") - 1).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text",
          label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The key, the counts, base_failed and kept of every document."""
    rows = save(features(docs, text, (F.col(key).alias("key"), F.col(stratum).alias("stratum")))
                .select("row.key", "row.stratum", *COUNTS).withColumn("base_failed", base_failed()))
    good = labels.select(F.col(key).alias("key"), F.col(label).alias("q")).filter("q is not null") \
        .groupBy("key").agg((F.min("q") > 0).alias("good"))
    holdout = rows.filter(~F.col("base_failed")).join(good, "key")
    cuts = save(cutoffs(holdout.select("stratum", "good", orders(F.col("key")).alias("orders"), *COUNTS), alpha, delta))
    few = cuts.limit(MAX_STRATA + 1).count() <= MAX_STRATA
    cuts = cuts.withColumnRenamed("stratum", "of")
    cuts = F.broadcast(cuts) if few else cuts
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    return rows.join(cuts, rows["stratum"].eqNullSafe(cuts["of"]), "left") \
        .select(F.col("key").alias(key), *COUNTS, "base_failed",
                (~F.col("base_failed") & ~rejected).alias("kept"), *[f"cut_{r}" for r in RULES])
