"""Standardisation: fit = one global aggregate, apply = column arithmetic.

Population standard deviation (not Spark ML's sample one); a feature whose
variance is zero up to rounding gets scale 1, so it is only centred.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import as_col

EPS = 2.220446049250313e-16  # float64 machine epsilon


def _scale(var: Column, mean: Column, n: Column) -> Column:
    nd = n.cast("double")
    bound = nd * F.lit(EPS) * var + F.pow(nd * mean * F.lit(EPS), 2)
    return F.when(var <= bound, F.lit(1.0)).otherwise(F.sqrt(var))


def fit_scaler(df: DataFrame, features: dict[str, Column | str]) -> DataFrame:
    """(feature, ord, mean, scale, n): one partial+final aggregate, F rows out."""
    aggs = []
    for i, (name, c) in enumerate(features.items()):
        x = as_col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    parts = [F.struct(F.lit(name).alias("feature"), F.lit(i).alias("ord"),
                      F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var"))
             for i, name in enumerate(features)]
    long = row.select("n", F.explode(F.array(*parts)).alias("p")).select("p.*", "n")
    return long.select("feature", "ord", "mean",
                       _scale(F.col("var"), F.col("mean"), F.col("n")).alias("scale"), "n")


def fit_array_scaler(df: DataFrame, array_col: str, names: list[str]) -> DataFrame:
    """Fit on the elements of a fixed-width array column, one feature each."""
    return fit_scaler(df, {n: F.element_at(F.col(array_col), i + 1) for i, n in enumerate(names)})


@dataclass
class ScalerModel:
    """Fitted parameters, small (one entry per feature)."""

    features: list[str]
    mean: list[float]
    scale: list[float]

    @classmethod
    def from_df(cls, params: DataFrame) -> "ScalerModel":
        rows = sorted(params.select("feature", "ord", "mean", "scale").collect(),
                      key=lambda r: r["ord"])
        return cls([r["feature"] for r in rows],
                   [float(r["mean"]) if r["mean"] is not None else 0.0 for r in rows],
                   [float(r["scale"]) if r["scale"] is not None else 1.0 for r in rows])

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(f, i, m, s) for i, (f, m, s) in enumerate(zip(self.features, self.mean, self.scale))],
            "feature string, ord int, mean double, scale double")

    def column(self, name: str, c: Column | str) -> Column:
        i = self.features.index(name)
        return (as_col(c).cast("double") - F.lit(self.mean[i])) / F.lit(self.scale[i])

    def transform(self, df: DataFrame, cols: dict[str, Column | str] | None = None,
                  suffix: str = "") -> DataFrame:
        cols = cols or {f: f for f in self.features}
        return df.withColumns({f + suffix: self.column(f, c) for f, c in cols.items()})

    def array(self, c: Column | str) -> Column:
        """Scale a fixed-width array column element-wise."""
        means = F.array(*[F.lit(m) for m in self.mean])
        scales = F.array(*[F.lit(s) for s in self.scale])
        scaled = F.zip_with(as_col(c), means, lambda x, m: x.cast("double") - m)
        return F.zip_with(scaled, scales, lambda x, s: x / s)
