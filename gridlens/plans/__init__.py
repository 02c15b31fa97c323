"""The registered queries. ``ORACLES`` holds the SQL of those that SQL can say."""

from gridlens.plans import experiments, learning, live, statistics, tables  # noqa: F401  (registers on import)
from gridlens.plans.registry import QUERIES
from gridlens.plans.registry import SQL as ORACLES

__all__ = ["ORACLES", "QUERIES"]
