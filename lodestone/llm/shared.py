"""Intermediate tables in the folder that driver and executors share, and names that are free in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import folder, written

__all__ = ["folder", "unused", "written"]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
