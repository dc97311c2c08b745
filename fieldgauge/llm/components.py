"""Connected components by large-star and small-star steps, with hub nodes kept out of joins.

A node of very many ties would be a hot key. The nodes that hold more than one in ``HUBS`` of
all ties are fewer than ``2 * HUBS``, so their least neighbours are broadcast; the ties of the
others are joined by shuffling. Minima are combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import stored

HUBS = 2000


def _with_least(ties: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """ties (u, v) with the least neighbour m of u. least: of, m, n (its ties)."""
    hub = F.col("n") * HUBS > total
    near = F.broadcast(least.where(hub).select("of", "m"))
    far = least.where(~hub).select("of", "m")
    hubs = ties.join(near, F.col("u") == F.col("of"))
    rest = ties.join(near.select(F.col("of").alias("hub")), F.col("u") == F.col("hub"),
                     "left_anti")
    return hubs.unionByName(rest.join(far, F.col("u") == F.col("of"))).drop("of")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a, b. (id, root): every linked id with the least id it is connected to.

    Each step is written, which ends its lineage. Ids without links are not returned.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), f"{name}-edges")
    total = edges.count()
    while total:
        # Large star: every larger neighbour of a node is tied to the node's least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy(F.col("u").alias("of")).agg(
            F.least("of", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-least")
        large = stored(
            _with_least(both.where("v > u"), least, 2 * total)
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            f"{name}-large")
        # Small star: a node and its smaller neighbours are tied to the least of these.
        low = large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"),
                                                        F.count(F.lit(1)).alias("n"))
        least = stored(low, f"{name}-low")
        turned = _with_least(large, least, large.count()).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(turned.unionByName(least.select(F.col("of").alias("u"),
                                                       F.col("m").alias("v")))
                       .where("u <> v").distinct(), f"{name}-small")
        # Stars only: every node has one tie, and no centre has a tie of its own.
        total, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if total == nodes and edges.select("v").distinct().join(
                edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
