"""Version vectors: MAP of peer to counter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def includes(a: Column, b: Column) -> Column:
    """True when ``a`` has seen everything ``b`` has; an absent peer counts as 0."""
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.try_element_at(a, e["key"]), F.lit(0)) >= e["value"])


def compare_versions(a: Column, b: Column) -> Column:
    """equal, includes (a is ahead), dominated (b is ahead) or concurrent."""
    ahead, behind = includes(a, b), includes(b, a)
    return (
        F.when(ahead & behind, "equal").when(ahead, "includes").when(behind, "dominated").otherwise("concurrent")
    )
