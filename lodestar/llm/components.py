"""Connected components by random contraction, in rounds of joins and counts that Spark can split on hub nodes."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.tables import stored


def connected_components(edges: DataFrame, seed: int = 7, hub_rounds: int = 0) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a long, b long)``; nodes share a root when a path joins them.

    In each round every node moves to its least neighbour (itself included) in an order drawn anew by
    an exclusive-or mask, and edges are rewritten to the new names; the number of edges shrinks
    geometrically, whatever the shape of the component. In the first ``hub_rounds`` rounds the order is by number
    of edges, so the ends of a star are at its hub at once. Null ends, self loops and repeated edges
    change nothing. Every round is written to the shared folder.
    """
    draw = random.Random(seed)
    live = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    moves = []
    while live.head(1):
        mask = F.lit(draw.getrandbits(63))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = to_hubs(both) if len(moves) < hub_rounds else (
            both.groupBy("a")
            .agg(F.min(F.col("b").bitwiseXOR(mask)).alias("near"))
            .select(F.col("a").alias("node"), F.least("near", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("root"))
        )
        move = stored(move, "moves")
        moves.append(move)
        live = stored(
            live.join(move.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[0]
    for move in moves[1:]:
        then = move.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


def to_hubs(both: DataFrame) -> DataFrame:
    """``node, root``: every node of ``both(a, b)``, which has each edge both ways, and that of itself and its neighbours which has the most edges."""
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    best = both.join(degree.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.struct("n", "b")).alias("x"), F.count(F.lit(1)).alias("n"))
    return best.select(F.col("a").alias("node"), F.greatest("x", F.struct("n", F.col("a").alias("b")))["b"].alias("root"))
