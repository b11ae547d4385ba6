"""Connected components of a link table, by alternating large and small stars, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from learnlens.sources.scratch import written

LINKS_EACH = 1 << 20


def _pointed(edges: DataFrame) -> DataFrame:
    """Links from the larger to the smaller end, each once."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Every node's neighbours (the larger ones, or the smaller ones and itself) are linked with the least of its neighbours.

    The minimum is aggregated before it is shuffled, so a node with very many links costs a row per task. What a shuffle deals out is
    read by ``tasks`` tasks at most.
    """
    around = links.select("a", "b")
    if large:
        around = around.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    pairs = around.join(least, "a").coalesce(tasks)
    if large:
        return _pointed(pairs.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))).coalesce(tasks)
    return _pointed(pairs.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")).coalesce(tasks))).coalesce(tasks)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable), for every node that has a link to another.

    Steps have a task per ``LINKS_EACH`` links, and one per core of the session at least, so that few links in many partitions cost little.
    """
    tasks_for = lambda n: max(links.sparkSession.sparkContext.defaultParallelism, -(-n // LINKS_EACH))
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    current = written(_pointed(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    before = None
    while (now := tuple(current.agg(*mark).first())) != before and now[0]:
        before, tasks = now, tasks_for(now[0])
        current = written(_star(_star(current, True, tasks), False, tasks), "links")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return written(nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks_for(now[0]))), "components")
