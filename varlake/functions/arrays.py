"""Action and state vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gripper_to_env(action) -> Column:
    """Last element from [0, 1] to {-1, 0, +1} with the sign flipped; the rest unchanged."""
    a = _col(action)
    last = F.element_at(a, -1).cast("double")
    flipped = F.lit(0.0) - F.signum(last * 2 - 1)
    head = F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda x: x.cast("double"))
    return F.when(F.size(a) > 0, F.concat(head, F.array(flipped)))


def state_vector(*arrays) -> Column:
    """Position, rotation and gripper readings end to end."""
    return F.concat(*[_col(a) for a in arrays])
