"""Column names that do not clash with those of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as make them new to ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out
