"""Containment join: which ranges hold a point.

A range goes into cells of about its own size, so it lies in two at most, and a point asks one cell of each size that is in
use. What meets is joined by equality of path, size and cell, with the containment as a residual, so a point meets only
ranges of which it is within a few lengths; no pairs of all points and ranges of a path are made. Sizes are powers of GROWTH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.operators.joins import met

GROWTH = 8
#: Sizes up to GROWTH ** 10, which is beyond any text.
SIZES = [GROWTH**k for k in range(1, 11)]


def _size(length: Column) -> Column:
    """The smallest size that isn't below a length."""
    return F.coalesce(*[F.when(length <= s, F.lit(s).cast("long")) for s in SIZES[:-1]], F.lit(SIZES[-1]).cast("long"))


def cell(at: Column, size: Column) -> Column:
    return F.call_function("div", at, size)


def within(points: DataFrame, ranges: DataFrame, key: str = "path", at: str = "at", low: str = "low", high: str = "high") -> DataFrame:
    """A row for each point and each range of its key with low < at < high, with the columns of both; apart from the key they must have different names. Ranges or points with a null bound or key meet nothing; a range whose high isn't above its low holds nothing."""
    sized = ranges.where(F.col(low) < F.col(high)).withColumn("_size", _size(F.col(high) - F.col(low) + 1))
    cells = F.array_distinct(F.array(cell(F.col(low), F.col("_size")), cell(F.col(high), F.col("_size"))))
    placed = sized.withColumn("_cell", F.explode(cells))
    asked = points.withColumn("_size", F.explode(F.array(*[F.lit(s).cast("long") for s in SIZES]))).withColumn("_cell", cell(F.col(at), F.col("_size")))
    used = sized.select("_size").distinct()  # ten rows at most
    asked = asked.join(F.broadcast(used), "_size", "left_semi")
    return met(asked, placed, [key, "_size", "_cell"]).where((F.col(low) < F.col(at)) & (F.col(at) < F.col(high))).drop("_size", "_cell")
