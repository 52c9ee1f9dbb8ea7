"""What the training-data operators take from the library."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..tables import columns_apart, drop_path, is_empty, new_path, shared_dir, stage, table, union_all, unstage

__all__ = ["columns_apart", "drop_path", "is_empty", "new_path", "shared_dir", "stage", "table", "union_all", "unstage", "unused"]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
