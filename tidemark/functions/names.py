"""Names for columns that an operator needs for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(name: str, *frames: DataFrame) -> str:
    """`name`, or it with underscores behind it until no frame has such a column, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
