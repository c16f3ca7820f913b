"""Connected components of a graph in DataFrames: alternating large and small stars, one table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenospark.llm.texts import Stage


def _hang(neighbours: DataFrame, least: DataFrame) -> DataFrame:
    return neighbours.join(least, "u")


def _all_stars(edges: DataFrame) -> bool:
    """No node has two parents, or a parent and children."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> tuple[DataFrame, list[Stage]]:
    """(node, component) for every node of ``edges`` (src, dst longs); component is the smallest node reachable.

    Each round hangs neighbours under the smallest one, so stars grow and chains halve. Minima combine on the map side and
    the joins are plain equi-joins, which Spark splits when one star is hot. Rounds are cut by tables in the shared folder.
    """
    now = Stage(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct(), "edges")
    for _ in range(max_rounds):
        if _all_stars(now.df):
            break
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = _hang(both, least).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = _hang(large, least)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = Stage(small, "edges")
        now.drop()
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), [now]
