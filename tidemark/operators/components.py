"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import checkpoint, shuffles_freed


def _hang(pairs: DataFrame) -> DataFrame:
    """For each node `u` of (u, v), hang u and its `v`s on the smallest of them.

    The minima are partial sums. They are checkpointed before the join, so that the
    join is a stage of its own: adaptive execution then deals the links of a hub to
    several tasks, which a join that shares its stage with an aggregate forbids.
    """
    low = checkpoint(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.join(low, "u")


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", most: int = 100) -> DataFrame:
    """(node, component) for every node of `links`; component is the smallest node reached.

    Large-star and small-star steps run in turn (each a min-aggregation and an
    equi-join on the node) until the table of links stays as it is; each round is
    checkpointed. A round at least halves the depth of what is left, so `most` rounds
    are beyond any table; reaching them is an error, never a partial result. Self links
    and null ends are ignored, so a node that has no other link is absent. An empty
    table gives an empty one.
    """
    edges = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = None
    for _ in range(most):
        with shuffles_freed(edges.sparkSession):
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == was:
            break
        was = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = checkpoint(large.distinct())
        hung = _hang(large)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
