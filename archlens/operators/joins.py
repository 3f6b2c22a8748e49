"""Joins and layout of rows that are made from others, whose sizes the planner can't know.

A text that an expression makes counts for twenty bytes in the planner's estimates, and what is exploded from it for no more
rows than there were, so tables of gigabytes look small enough to be gathered at the driver and sent around. What is joined
here is sorted and shuffled whatever it looks like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left.join(right), never by way of the driver."""
    return left.join(right.hint("merge"), on, how)


def dealt(files: DataFrame) -> DataFrame:
    """files by path. A short file of a table may hold very many texts; they are dealt out before they are read, and windows and joins by path need no further shuffle."""
    return files.repartition("path")
