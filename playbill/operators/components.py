"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove, stored

#: Rounds needed grow with the logarithm of the longest chain; this is only a guard against a defect.
MAX_ROUNDS = 60
#: Nodes with more than one link in so many are hot; there can only be as many of them as this figure.
HOT_NODES = 10_000


def _to_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Rows joined to the least neighbour m of their node u.

    The few nodes with very many links are sent to the rows, so no task gets all links of one; the others are dealt by a shuffle.
    """
    hot = F.broadcast(least.where(F.col("n") * HOT_NODES > total))
    cold = least.where(F.col("n") * HOT_NODES <= total)
    return rows.join(hot, "u").unionByName(rows.join(hot, "u", "left_anti").join(cold, "u")).drop("n")


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _to_least(both.where("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of those."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    lower = _to_least(links, least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """The least node reachable from every node that has a link.

    `links`: columns u and v (long), in any direction, repeats and loops allowed; rows with a null are ignored. Returns a
    frame (node, root) without the roots themselves, and the scratch tables it reads. No links: an empty frame. Each step
    is written to the shared folder, so a lost executor costs at most one step.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    table, path = stored(links, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        seen = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state or not seen["n"]:
            return table.select(F.col("u").alias("node"), F.col("v").alias("root")), [path]
        state = (seen["n"], seen["h"])
        large, large_path = stored(_large_star(table, seen["n"]).distinct(), "links")
        stepped, new = stored(_small_star(large, large.count()).distinct(), "links")
        remove(table.sparkSession, path)
        remove(table.sparkSession, large_path)
        table, path = stepped, new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
