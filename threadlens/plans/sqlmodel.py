"""DuckDB twins of the scoring layers (oracle SQL only)."""

from __future__ import annotations

from ..operators.score import Linear


def num(v: float) -> str:
    return f"({float(v)!r})::DOUBLE"


def linear(inputs: list[str], lin: Linear) -> list[str]:
    """Same summation order as Spark's aggregate(zip_with): ((0+x0w0)+x1w1)...+b."""
    outs = []
    for row, b in zip(lin.weight, lin.bias):
        terms = " + ".join(f"CAST({x} AS DOUBLE) * {num(w)}" for x, w in zip(inputs, row))
        outs.append(f"((0.0::DOUBLE + {terms}) + {num(b)})")
    return outs


def relu(exprs: list[str]) -> list[str]:
    return [f"greatest({e}, 0.0::DOUBLE)" for e in exprs]


def softmax(cols: list[str]) -> list[str]:
    m = f"greatest({', '.join(cols)})"
    s = " + ".join(f"exp({c} - {m})" for c in cols)
    return [f"exp({c} - {m}) / (0.0::DOUBLE + {s})" for c in cols]


def argmax(cols: list[str]) -> str:
    """First index of the maximum."""
    m = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {m} THEN {i}" for i, c in enumerate(cols)) + " END"
