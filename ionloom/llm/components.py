"""Connected components of an undirected graph given as edges, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ionloom.llm.files import written


def _state(edges: DataFrame) -> tuple:
    row = edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, root): each node that has an edge, and the smallest node of its component.

    ``edges`` has the columns u and v of one type; null ends, loops and repeats are
    dropped. Alternating large-star and small-star steps: every step links nodes to
    the smallest neighbour, found by an aggregate that combines on the map side, so
    a node with very many neighbours is never gathered in one task. Each round's
    edges are a table in the shared folder.
    """
    u, v = F.col("u"), F.col("v")
    oriented = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    current = written(oriented.distinct(), "edges")
    state = _state(current)
    while True:
        both = current.unionByName(current.select(v.alias("u"), u.alias("v")))
        # the aggregates are tables, so each join reads two plain scans and AQE can split a hot node
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
        large = written(large.where(u != v).distinct(), "large")
        root = written(large.groupBy("u").agg(F.min("v").alias("m")), "root")
        small = large.join(root, "u").select(v.alias("u"), F.col("m").alias("v"))
        small = small.unionByName(root.select("u", F.col("m").alias("v")))
        following = written(small.where(u != v).distinct(), "edges")
        before, state = state, _state(following)
        current = following
        if state == before:
            break
    return current.select("u", v.alias("root")).unionByName(
        current.select(v.alias("u"), v.alias("root")).distinct()
    )
