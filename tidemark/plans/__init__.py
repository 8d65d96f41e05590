"""Named queries (Spark) and their DuckDB oracles, registered on import."""

from tidemark.plans import build, codebleu, flow, io, perturb, records, scoring  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
