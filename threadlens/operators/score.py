"""Scoring with a late-fusion classifier given as a weights table.

content (D) -> 10, statistics (6) -> 3, lexicon (L) -> 20, each ReLU'd,
concatenated (33) -> fusion 10 + ReLU -> output C logits -> softmax.
Dropout is the identity at scoring time. Each layer is one Project of
``aggregate(zip_with(...))`` expressions over an ``array<double>``; layers
are separate Projects so a layer is computed once, not re-expanded inside
every unit of the next one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A

LAYERS = ("content", "stats", "lexicon", "fusion", "out")


@dataclass
class Linear:
    weight: list[list[float]]   # rows = output units
    bias: list[float]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.weight), len(self.weight[0]) if self.weight else 0

    def __call__(self, x: Column | str) -> Column:
        return A.linear(x, self.weight, self.bias)


def rule_linear(n_out: int, n_in: int, seed: int) -> Linear:
    """Deterministic weights from a rule (for fixtures and examples)."""
    amp = 1.0 / math.sqrt(max(n_in, 1))
    w = [[round(math.sin(seed * 12.9898 + o * 78.233 + i * 37.719) * amp, 6)
          for i in range(n_in)] for o in range(n_out)]
    b = [round(math.cos(seed * 4.1414 + o * 2.718) * 0.1, 6) for o in range(n_out)]
    return Linear(w, b)


@dataclass
class FusionModel:
    content: Linear
    stats: Linear
    lexicon: Linear
    fusion: Linear
    out: Linear

    @classmethod
    def from_rule(cls, content_dim: int, lexicon_dim: int, n_classes: int, seed: int = 1,
                  content_out: int = 10, stats_out: int = 3, lexicon_out: int = 20,
                  fusion_out: int = 10) -> "FusionModel":
        return cls(rule_linear(content_out, content_dim, seed),
                   rule_linear(stats_out, 6, seed + 1),
                   rule_linear(lexicon_out, lexicon_dim, seed + 2),
                   rule_linear(fusion_out, content_out + stats_out + lexicon_out, seed + 3),
                   rule_linear(n_classes, fusion_out, seed + 4))

    def layers(self) -> dict[str, Linear]:
        return {n: getattr(self, n) for n in LAYERS}

    def to_table(self, spark: SparkSession) -> DataFrame:
        """Long weights table (layer, out_idx, in_idx, value); in_idx -1 = bias."""
        rows = []
        for name, lin in self.layers().items():
            for o, (row, b) in enumerate(zip(lin.weight, lin.bias)):
                rows.append((name, o, -1, float(b)))
                rows += [(name, o, i, float(v)) for i, v in enumerate(row)]
        return spark.createDataFrame(rows, "layer string, out_idx int, in_idx int, value double")

    @classmethod
    def from_table(cls, table: DataFrame) -> "FusionModel":
        """Rebuild from a weights table (model-sized, so collected once)."""
        cells: dict[str, dict[tuple[int, int], float]] = {}
        for r in table.collect():
            cells.setdefault(r["layer"], {})[(r["out_idx"], r["in_idx"])] = r["value"]
        lins = {}
        for name in LAYERS:
            c = cells[name]
            n_out = 1 + max(o for o, _ in c)
            n_in = 1 + max(i for _, i in c)
            lins[name] = Linear([[c[(o, i)] for i in range(n_in)] for o in range(n_out)],
                                [c[(o, -1)] for o in range(n_out)])
        return cls(**lins)


def fusion_scores(df: DataFrame, model: FusionModel, content: str, stats: str, lexicon: str,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., logits, probs, prediction, score) from three feature arrays."""
    h = df.select(*keep, A.relu(model.content(content)).alias("_hc"),
                  A.relu(model.stats(stats)).alias("_hs"),
                  A.relu(model.lexicon(lexicon)).alias("_hl"))
    f = h.select(*keep, A.relu(model.fusion(F.concat("_hc", "_hs", "_hl"))).alias("_f"))
    z = f.select(*keep, model.out("_f").alias("logits"))
    p = z.select(*keep, "logits", A.softmax("logits").alias("probs"))
    return p.select(*keep, "logits", "probs", A.argmax("probs").alias("prediction"),
                    A.last_score("probs").alias("score"))


def head_scores(df: DataFrame, head: Linear, content: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text-only head: logits, probabilities, arg-max and last-column score."""
    z = df.select(*keep, head(content).alias("logits"))
    return z.select(*keep, "logits", A.softmax("logits").alias("probs"),
                    A.argmax("logits").alias("prediction"),
                    A.last_score("logits").alias("score"))


def row_losses(scored: DataFrame, label: str, logits: str = "logits") -> DataFrame:
    """Cross-entropy per row."""
    return scored.withColumn("loss", A.cross_entropy(logits, label))


def mean_batch_loss(df: DataFrame, loss: str, batch: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of per-batch mean losses (a short last batch weighs as much as a
    full one), next to the row-weighted mean."""
    b = df.groupBy(*by, batch).agg(F.avg(loss).alias("_bm"), F.sum(loss).alias("_bs"),
                                   F.count(F.lit(1)).alias("_bn"))
    return b.groupBy(*by).agg(F.avg("_bm").alias("mean_batch_loss"),
                              (F.sum("_bs") / F.sum("_bn")).alias("row_mean_loss"),
                              F.count(F.lit(1)).alias("n_batches"))
