"""Connected components of an edge table, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of the edge table ``(a, b)``; the component is its smallest id.

    Alternates large-star and small-star steps until the edge set stays the
    same; a step keeps at most as many edges as it was given, and each result is
    written to the shared folder, so lineage does not grow.  Self-links and null
    ends are ignored; an empty table gives an empty table.
    """
    current = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(root, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(root.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        )
        current = stored(small, "edges")
        before, mark = mark, _mark(current)
        if before == mark:
            break
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    """One row that tells two edge sets apart: their number and the sum of their hashes."""
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFFFF)), F.lit(0)).alias("s")).first()
    return row["n"], row["s"]
