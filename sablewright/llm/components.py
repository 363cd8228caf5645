"""Connected components of a graph of any size by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewright.llm.common import settled


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges``; the root is the least node of its component.

    Each round links all neighbours of a node to the least of them, first those above the node, then those below, and is
    written to shared storage, so that no round's lineage grows and lost executors cost one round at most. Links never
    grow in number, and a node with many links is split by the adaptive join. Loops and repeated edges do no harm;
    rows with a null end are left out. It ends when a round changes nothing.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = settled(now.distinct())
    links = now.where("u <> v")
    state = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least are written first: a join of two plain exchanges can be split where a node has very many links
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settled(large)
        # below: v < u holds for every link now, so a node's lesser neighbours are its v
        low = settled(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = settled(small)
        new = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    rooted = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
