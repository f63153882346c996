"""Small DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_most(rank: Column, n: float | None) -> Column:
    """Whether a rank lies within a limit; no limit keeps every row."""
    return F.lit(True) if n is None else rank <= n


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once.

    A plain projection is merged into the expressions that read it, so a costly column
    used several times is evaluated (and planned) several times.  A one-element
    generator keeps its own place in the plan.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
