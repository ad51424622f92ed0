"""Connected components of a graph given as edges, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.tables import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (smallest id of its component) for every end of an edge.

    Alternates two steps until nothing changes: each node's larger neighbours, then its smaller
    ones, are linked to its smallest neighbour. Both halve the distances, so rounds grow with the
    logarithm of the size. Edges never outnumber those given, loops and repeats may occur. Each
    round is written to the shared folder and deleted behind the next; only its count and checksum
    reach the driver.
    """
    links = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    whole, nodes = links, links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    state = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, links = links, cut(small)
        drop(large)
        if before is not whole:
            drop(before)
        new = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if new == state:
            break
        state = new
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    out = cut(nodes.join(roots, F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component")))
    for table in (whole, links):
        drop(table)
    return out
