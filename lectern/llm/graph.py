"""Connected components of an edge table by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, drop_scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v). Links u's neighbours to the smallest of u and its neighbours; large: only those above u.
    The minima are partial aggregates, and the join back is one that Spark can split where a node is hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node that has an edge to another; component is the smallest node reachable.
    Loops, repeated edges and edges with a null end are ignored; without edges the result is empty."""
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"{src} is not null and {dst} is not null and {src} <> {dst}").distinct()
    now = cut(pairs)
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == mark or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        mark = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after = cut(_star(_star(both, large=True), large=False))
        drop_scratch(now)
        now = after
    raise RuntimeError(f"components have not settled in {rounds} rounds")
