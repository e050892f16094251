"""Connected components by alternating large-star and small-star steps.

Each step replaces links by links to smaller neighbours; the links end as stars
whose centre is the smallest node of the component.  Links are written out after
every round, and nodes and links never reach the driver.  The smallest neighbours of nodes
with very many links are broadcast, so their links stay spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_groups, materialize, release


#: Up to this many links, the smallest neighbours of all nodes are small enough to broadcast (16 MB).
BROADCAST_LINKS = 500_000


def _large_star(links: DataFrame, n: int) -> tuple[DataFrame, list[DataFrame]]:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    written = []
    if n <= BROADCAST_LINKS:
        moved = both.where("b > a").join(F.broadcast(low), "a")
    else:
        written.append(materialize(low, "links-low"))
        moved = join_groups(both.where("b > a"), written[0], ["a"], "n", 2 * n)
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), written


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    others = links.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of longs to (node, component): every linked node with the smallest node it reaches.

    Nulls and links of a node with itself are ignored.  Raises RuntimeError if
    ``rounds`` rounds do not settle the links (they take about the square of the
    logarithm of the longest path).
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    links = materialize(links, "links")
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    state = links.agg(F.count(F.lit(1)), digest).first()
    for _ in range(rounds):
        if not state[0]:
            break
        star, written = _large_star(links, state[0])
        before, links = links, materialize(_small_star(star), "links")
        release(before, *written)
        now = links.agg(F.count(F.lit(1)), digest).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def name_components(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, rep) and ``connected_components`` of nodes to (node, name): the smallest rep of each linked node's component."""
    linked = materialize(classes.select("node", "rep").join(found, "node"), "component-members")
    names = linked.groupBy("component").agg(F.min("rep").alias("name"), F.count(F.lit(1)).alias("size"))
    return join_groups(linked.select("node", "component"), materialize(names, "component-names"), ["component"], "size").select("node", "name")
