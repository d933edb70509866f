"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged

#: Links of a hub, whose smallest neighbour goes out by broadcast; as many hubs at most.
HUB_LINKS, MOST_HUBS = 1000, 4096


def large_star(links: DataFrame, n: int) -> DataFrame:
    """Each link (a > b) with b's smallest neighbour, if that is smaller, for b. n: the number of links.

    Links of a hub stay where they are: there are no more hubs than MOST_HUBS, so their neighbours are broadcast.
    """
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hubs = links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HUB_LINKS, n // MOST_HUBS)).select(F.col("b").alias("hub"))
    known = hubs.join(least, F.col("hub") == F.col("a"), "left").select("hub", F.coalesce("m", "hub").alias("least"))
    # MOST_HUBS rows at most
    marked = links.join(F.broadcast(known), F.col("b") == F.col("hub"), "left")
    rest = marked.where("hub is null").select(F.col("a").alias("x"), F.col("b").alias("y")).join(least, F.col("y") == F.col("a"), "left").select(F.col("x").alias("a"), F.coalesce("m", "y").alias("b"))
    return marked.where("hub is not null").select("a", F.col("least").alias("b")).unionByName(rest).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) of every node in edges (a bigint, b bigint); root: the smallest node of its component.

    The rounds are logarithmic in the size of a component. Edges stay spread over partitions: a node's smallest
    neighbour is found with partial aggregation and joined back, never by gathering a node's neighbours. Links of a
    node with itself, and null ones, count as none; an empty table has no nodes.
    """
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    old = state(links)
    for _ in range(most_rounds):
        large = large_star(links, old[0])
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        links = staged(large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        new = state(links)
        if old == new:
            break
        old = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
