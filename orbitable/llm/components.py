"""Connected components of a link table by alternating stars, one written table per round.

Each half round is a grouped minimum and a join on the node, so a node with a third of all links
is pre-aggregated in the tasks and its join partition can be split. No component is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.session import cut_lineage


def _star(both: DataFrame, small: bool) -> DataFrame:
    """Links of each node's neighbours to the least of them; `both` holds (u, v) in the needed directions."""
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id reachable, for every node of `edges`.

    Nulls and loops are ignored; repeated links count once. An empty table gives an empty result.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = cut_lineage(links.filter("u is not null and v is not null and u <> v").distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = cut_lineage(_star(both, small=False))
        links = cut_lineage(_star(links, small=True))
        # Done when every node has one parent and no parent has one itself.
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                              F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("lo")).filter("up > 1 or up > lo").isEmpty():
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
