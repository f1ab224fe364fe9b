"""Connected components of a graph given as an edge table, by alternating stars.

Each round joins every edge to the smallest neighbour of its larger (then smaller) end, which
halves distances to the smallest id of a component. Edges live in tables in the shared folder;
the driver sees only two sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprynt.llm.common import dropped, written


def _star(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Large star, then small star: every node points at a smaller one of its component; and the tables in between.
    What is aggregated is a table before it is joined, so that the rows of a hub can be split among tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = written(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
    low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
    new = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return new, [least, large, low]


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), u <> v -> (u, v): every node of an edge but the smallest of its component, and that smallest.
    Rounds go on until nothing changes: some logarithm of the longest distance in a component."""
    now, last = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        # F.xxhash64 sums tell whether a round changed anything
        sums = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sums == last or not sums[0]:
            return now
        star, between = _star(now)
        last, new = sums, written(star, "edges")
        for t in (now, *between):
            dropped(t)
        now = new
