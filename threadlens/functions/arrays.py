"""Array maths for scoring: linear layers, ReLU, softmax, arg-max, losses.

Weights are literal arrays; each output unit is one ``aggregate(zip_with)``
expression. Higher-order functions are interpreted, so a layer's Project stands
outside whole-stage code generation; it still runs in the JVM, without Python.

Measured alternative, rejected: unrolling each unit into per-element
arithmetic (``get(x, i) * w_i``) lets the optimizer see through the layer
array and inline a whole layer into every unit of the next one; the fusion
forward pass got about twice as slow at sf0.1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.util import as_col


def _lit_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(x: Column | str, w: Sequence[float]) -> Column:
    prods = F.zip_with(as_col(x), _lit_array(w), lambda a, b: a.cast("double") * b)
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def linear(x: Column | str, weight: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """``W x + b`` with W given as rows (out x in)."""
    return F.array(*[dot(x, row) + F.lit(float(b)) for row, b in zip(weight, bias)])


def relu(x: Column | str) -> Column:
    return F.transform(as_col(x), lambda v: F.greatest(v, F.lit(0.0)))


def softmax(z: Column | str) -> Column:
    """Max-shifted softmax over an array."""
    z = as_col(z)
    m = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def log_sum_exp(z: Column | str) -> Column:
    z = as_col(z)
    m = F.array_max(z)
    return m + F.log(F.aggregate(F.transform(z, lambda v: F.exp(v - m)), F.lit(0.0),
                                 lambda acc, v: acc + v))


def argmax(z: Column | str) -> Column:
    """0-based index of the first maximum."""
    z = as_col(z)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def last_score(p: Column | str) -> Column:
    """The last column (positive-class score)."""
    return F.element_at(as_col(p), -1)


def cross_entropy(z: Column | str, label: Column | str) -> Column:
    """``logsumexp(z) - z[label]`` for one row of logits."""
    z = as_col(z)
    return log_sum_exp(z) - F.element_at(z, as_col(label).cast("int") + 1)
