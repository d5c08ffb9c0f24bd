"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target is its weight's share of the budget, at most ``CAP`` times its
size; what a capped source cannot take is shared by weight among the others,
until none is above its cap (one water level over all sources gives the same).
A document of a source is to be copied target / size times on average: the
whole part is certain, the fraction is rounded.

Pivotal rounding takes two documents with fractions p, q and sizes a, b and
moves words between them, keeping a*p + b*q, until one fraction is 0 or 1; the
direction is drawn so that each keeps its mean. The last fraction of a source goes
to the nearer whole, so the words that a source takes differ from its target by
at most half a document. Documents of a source are
folded in buckets of about ``FAN``; each bucket leaves at most one fraction,
and buckets' residuals are folded again, ``FAN`` to one, up a tree to the source.

Draws come from hashes of the documents paired, so reruns agree. Repeated rows
are told apart by a running number. Defined results: a null or empty text has
size 0 and takes nothing; a null source is a source, the last in order; a null id
is an id; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save
from .quality import words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
FAN = 64
#: Fractions nearer to 0 or 1 than this are whole.
NEAR = 1e-9
_DONE = "array<struct<id:bigint,nth:int,size:bigint,up:int>>"


def allocate(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target and n of each source, from rows (source, size).

    The windows run over one row a source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1)))
    sources = sources.withColumn("most", F.col("source_size") * float(cap))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * float(share)
    full = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the level if this source and all above it in order stay below their caps
    sources = sources.withColumn("level", (budget - full) / open_weight)
    level = F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    return sources.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))) \
        .select("source", "source_size", "n", "target")


def _pair(held: Column, x: Column) -> Column:
    """Move words between two fractions; the pair's whole one joins ``done``."""
    a, b, p, q = held["size"].cast("double"), x["size"].cast("double"), held["p"], x["p"]
    rise = F.least(1 - p, q * b / a)  # of the held fraction, if words come to it
    fall = F.least(p, (1 - q) * b / a)
    draw = F.pmod(F.xxhash64(held["id"], held["nth"], x["id"], x["nth"]), F.lit(1 << 52)) / float(1 << 52)
    facts = F.struct(held.alias("held"), x.alias("x"), rise.alias("rise"), fall.alias("fall"),
                     (draw * (rise + fall) < fall).alias("up"))

    def settle(v: Column) -> Column:
        a, b = v["held"]["size"].cast("double"), v["x"]["size"].cast("double")
        p, q = v["held"]["p"], v["x"]["p"]
        held_whole = F.when(v["up"], 1 - p <= q * b / a).otherwise(p <= (1 - q) * b / a)
        left = F.when(v["up"], q - v["rise"] * a / b).otherwise(q + v["fall"] * a / b)
        kept = F.when(v["up"], p + v["rise"]).otherwise(p - v["fall"])
        up = v["up"].cast("int")
        return F.struct(F.when(held_whole, v["x"]["id"]).otherwise(v["held"]["id"]).alias("id"),
                        F.when(held_whole, v["x"]["nth"]).otherwise(v["held"]["nth"]).alias("nth"),
                        F.when(held_whole, v["x"]["size"]).otherwise(v["held"]["size"]).alias("size"),
                        F.when(held_whole, left).otherwise(kept).alias("p"),
                        F.struct(F.when(held_whole, v["held"]["id"]).otherwise(v["x"]["id"]).alias("id"),
                                 F.when(held_whole, v["held"]["nth"]).otherwise(v["x"]["nth"]).alias("nth"),
                                 F.when(held_whole, v["held"]["size"]).otherwise(v["x"]["size"]).alias("size"),
                                 F.when(held_whole, up).otherwise(1 - up).alias("up")).alias("gone"))

    def close(v: Column) -> Column:
        whole = (v["p"] < NEAR) | (v["p"] > 1 - NEAR)
        last = F.struct(v["id"], v["nth"], v["size"], F.when(v["p"] > 0.5, 1).otherwise(0).alias("up"))
        done = F.concat(held["done"], F.array(v["gone"]), F.when(whole, F.array(last)).otherwise(F.array()))
        return _state(v["id"], v["nth"], v["size"], F.when(whole, F.lit(0.0)).otherwise(v["p"]), done)

    # transform over one element names intermediate results, which are then computed once
    return F.get(F.transform(F.transform(F.array(facts), settle), close), 0)


def _state(id_: Column, nth: Column, size: Column, p: Column, done: Column) -> Column:
    return F.struct(id_.cast("bigint").alias("id"), nth.cast("int").alias("nth"), size.cast("bigint").alias("size"),
                    p.cast("double").alias("p"), done.cast(_DONE).alias("done"))


def _fold(items: Column) -> Column:
    """Fold a bucket's fractions: those settled, and at most one left (p is 0 if none is)."""
    none = _state(F.lit(None), F.lit(0), F.lit(0), F.lit(0.0), F.array())
    return F.aggregate(
        items, none,
        lambda held, x: F.when(held["p"] == 0, _state(x["id"], x["nth"], x["size"], x["p"], held["done"]))
        .otherwise(_pair(held, x)))


def mix(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """id, source, size, nth, source_size, target and copies of every row (id, source, size).

    ``nth`` numbers the rows that agree in id, source and size, from 1.
    """
    repeats = Window.partitionBy("id", "source", "size").orderBy(F.lit(0))
    sizes = save(sizes.select("id", "source", "size").withColumn("nth", F.row_number().over(repeats)))
    shares = save(allocate(sizes, weights, share, cap))
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(mean + NEAR)
    p = F.when((F.col("size") == 0) | (mean - whole < NEAR), 0.0).otherwise(mean - whole)
    rows = sizes.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))) \
        .select("id", "source", "size", "nth", "source_size", "target", "n", whole.alias("whole"), p.alias("p"))
    of_source = ["source", "source_size", "target", "whole"]
    settled = rows.filter("p = 0").select(*of_source, "id", "nth", "size", F.lit(0).alias("up"))

    item = F.struct(F.xxhash64("id", "nth", "size").alias("turn"), "id", "nth", "size", "p")
    buckets = F.ceil(F.col("n") / FAN)
    level = rows.filter("p > 0").select(
        *of_source, item.alias("item"), buckets.alias("buckets"),
        F.pmod(F.xxhash64(F.lit(1), "id", "nth", "size"), buckets).alias("bucket"))
    most = shares.agg(F.max("n")).first()[0] or 0
    left = -(-most // FAN)
    while left:
        folded = save(level.groupBy(*of_source, "buckets", "bucket")
                      .agg(_fold(F.sort_array(F.collect_list("item"))).alias("fold")))
        settled = settled.unionByName(folded.select(*of_source, F.inline("fold.done")))
        rest = folded.filter("fold.p > 0")
        item = F.struct(F.xxhash64("fold.id", "fold.nth", "fold.size").alias("turn"), "fold.id", "fold.nth",
                        "fold.size", "fold.p")
        fewer = F.ceil(F.col("buckets") / FAN)
        level = rest.select(*of_source, item.alias("item"), fewer.alias("buckets"),
                            F.floor(F.col("bucket") / FAN).alias("bucket"))
        left = 0 if left == 1 else -(-left // FAN)
    if most:  # one fraction a source may be left; the nearer whole keeps the source nearest to its target
        settled = settled.unionByName(level.select(
            *of_source, "item.id", "item.nth", "item.size", (F.col("item.p") >= 0.5).cast("int").alias("up")))
    return settled.select("id", "source", "size", "nth", "source_size", "target",
                          (F.col("whole") + F.col("up")).cast("long").alias("copies"))


def size_of(text: str = "text") -> Column:
    return F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long")


def remix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (doc_id, source and ``text`` among them), each as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "source", size_of(text).alias("size"))
    copies = mix(rows).filter("copies > 0").select(
        F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"),
        F.col("nth").alias("of_nth"), "copies")
    repeats = Window.partitionBy("id", "source", "size").orderBy(F.xxhash64(F.col(f"row.{text}")))
    rows = rows.withColumn("nth", F.row_number().over(repeats))
    taken = rows.join(copies, F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source"))
                      & (F.col("size") == F.col("of_size")) & (F.col("nth") == F.col("of_nth")))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
