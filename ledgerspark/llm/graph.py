"""Connected components by randomised contraction, as Spark joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links between long node numbers to ``(node, root)``, one row for each node with a link.

    Each round every node moves to its neighbour of lowest random rank (or stays), and links move with it. Any
    graph, paths included, loses a constant share of its nodes a round, so rounds grow with the logarithm of the
    largest component. Ranks change each round. A node with very many links is pre-aggregated before the shuffle,
    and joins on it are between exchanged tables, which AQE can split. Null ends and self links are ignored.
    """
    links = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    roots = None
    turn = 0
    while not links.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("to"))).alias("m"))
        moves = stored(
            best.select(
                F.col("a").alias("node"), F.when(F.col("m.r") < rank(F.col("a")), F.col("m.to")).otherwise(F.col("a")).alias("to")
            ),
            "moves",
        )
        if roots is None:
            roots = stored(moves.withColumnRenamed("to", "root"), "roots")
        else:
            step = moves.select(F.col("node").alias("root"), "to")
            last = roots
            roots = stored(
                last.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
            )
            discard(last)
        from_a = moves.select(F.col("node").alias("a"), F.col("to").alias("x"))
        from_b = moves.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(from_a, "a").join(from_b, "b").where("x <> y")
        last = links
        links = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(last, moves)
        turn += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
