"""Connected components of a graph given by its edges, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import stage


#: Edges of a file; a round has about as many as the one before.
EDGES = 200_000


def _staged(edges: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges, written, and a count and a sum that tell them from other edges; both come with the writing."""
    seen = Observation()
    out = stage(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), name, rows=rows, rows_per_file=EDGES)
    return out, (seen.get["n"], seen.get["hash"])


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node, component`` for the nodes of the edges ``u, v`` (long); a component is its smallest node.

    Large-star and small-star steps in turn until nothing changes: each node
    points its larger neighbours, then its smaller ones, at the smallest that
    it knows.  A neighbourhood is only ever aggregated or joined, and Spark
    splits the join where a node has very many neighbours.  Self-loops and
    repeated edges do not matter; no edges give an empty table.
    """
    edges, state = _staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = stage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star", rows=state[0], rows_per_file=EDGES)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before = state
        edges, state = _staged(small.filter("u <> v").distinct(), "small-star", 2 * state[0])
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
