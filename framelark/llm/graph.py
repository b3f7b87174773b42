"""Connected components by alternating large-star and small-star steps (Kiveris and others, 2014)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable

#: An id with at least one in HUBS of all edges is a hub; there are at most HUBS of them.
HUBS = 1000
#: Edges that a task takes.
ROWS = 200_000


def with_least(edges: DataFrame, bound: int) -> DataFrame:
    """edges (u, v) with m, the smallest v of their u. What hubs (u with `bound` edges or more) have is broadcast, at most
    HUBS rows, so that a hub's edges stay where they are."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(low.where(F.col("n") >= bound).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("n") < bound).select("u", "m"), "u")
    return rest.unionByName(edges.join(hubs, "u"))


def tasks_for(rows: int) -> int:
    return max(4, -(-rows // ROWS))


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of a link (x, y) reaches. Ends without links are not listed. Stages
    have as many tasks as their edges need: a task leaves files behind for each shuffle, however few its rows."""
    edges = durable(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    while True:
        n = edges.count()
        tasks, bound = tasks_for(n), max(HUBS, -(-2 * n // HUBS))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        large = durable(with_least(both, bound).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).coalesce(tasks))
        small = with_least(large, bound)
        edges = durable(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        # done when all hang from ends that hang from none
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty():
            break
    return durable(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()).coalesce(tasks))
