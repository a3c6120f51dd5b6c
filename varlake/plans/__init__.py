"""The query catalogue and its SQL twins."""

from varlake.plans import episodes, files, messages, rollouts, tables  # noqa: F401
from varlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
