"""Column names that a table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own(docs: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as make it new to the table."""
    taken = {name.lower() for name in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def others(docs: DataFrame, *outputs: str) -> list[str]:
    """The table's columns but those that outputs of these names replace."""
    replaced = {name.lower() for name in outputs}
    return [f"`{name}`" for name in docs.columns if name.lower() not in replaced]
