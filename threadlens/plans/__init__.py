"""Registered queries: importing this package fills the registry."""

from . import q_encode, q_eval, q_features, q_io, q_runs, q_score, q_text  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
