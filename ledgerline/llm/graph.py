"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize


def _contract(pairs: DataFrame) -> DataFrame:
    """Hang every node of ``pairs`` (node, other) on the smallest node it meets there."""
    least = pairs.groupBy("node").agg(F.least("node", F.min("other")).alias("root"))
    return pairs.join(least, "node")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller neighbours
    likewise, until the edges are stars. Rounds grow with the logarithm of the longest path; each
    is written to the shared folder, so that lineage stays short and a lost executor costs one
    round. A hub's neighbours are never gathered: the hub's minimum is a combined aggregate and the
    join with it is one whose hot side Spark can split. Self-loops, repeated edges and no edges at
    all are allowed; nulls are not linked to anything.
    """
    stars = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(node, other))"), F.expr("bit_xor(xxhash64(other, node))")).first()
        if now == before or now[0] == 0:
            return stars.select("node", F.col("other").alias("root")).unionByName(
                stars.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct()
            )
        before = now
        both = stars.unionByName(stars.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _contract(both).where("other > node").select(F.col("other").alias("node"), F.col("root").alias("other")).distinct()
        small = _contract(large)
        stars = materialize(
            small.where("other <> root")
            .select(F.col("other").alias("node"), F.col("root").alias("other"))
            .unionByName(small.select("node", F.col("root").alias("other")))
            .distinct(),
            "stars",
        )
