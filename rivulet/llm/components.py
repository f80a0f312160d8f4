"""Connected components of a table of edges, by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("other").alias("row"), F.col("row").alias("other")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every row under the smallest of them and the row itself: the larger ones, or the others."""
    sides = _both(edges) if large else edges
    # Written first, so that the join shuffles both sides plainly and a row with very many neighbours can be split.
    low = settle(sides.groupBy("row").agg(F.least(F.min("other"), F.col("row")).alias("low")))
    met = sides.join(low, "row")
    if large:
        out = met.where("other > row").select(F.col("other").alias("row"), F.col("low").alias("other"))
    else:
        out = met.select(F.col("other").alias("row"), F.col("low").alias("other")).unionByName(low.select("row", F.col("low").alias("other")))
    return settle(out.where("row != other").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(row, label) for every row with an edge: the smallest row it is connected to.

    ``edges``: row, other; either direction, repeats and loops are allowed. Each round hangs the larger neighbours of
    every row, then the smaller ones, under the smallest; it ends when a round changes nothing.
    """
    now = settle(edges.where("row != other").select(F.greatest("row", "other").alias("row"), F.least("row", "other").alias("other")).distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("row", "other").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = _star(_star(now, large=True), large=False)
    children = now.select("row", F.col("other").alias("label"))
    return children.unionByName(now.select(F.col("other").alias("row"), F.col("other").alias("label")).distinct())
