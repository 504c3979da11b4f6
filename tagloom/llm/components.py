"""Connected components of a table of links, by contraction; nothing is gathered in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.storage import staged


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it reaches, for every node of ``links`` (``a``, ``b``).

    Each round hooks every node to its least neighbour, follows that pointer twice more, and replaces the links by links
    between the nodes pointed to; in a component of two nodes or more at least every other node goes. Loops and repeated
    links do no harm. Joins on a hub are plain equi-joins of two shuffled tables, which Spark splits where skewed.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = staged(links.select(low, high).distinct(), "links")
    result = None
    while True:
        rest = links.where("a <> b")
        if rest.isEmpty():
            break
        both = rest.select(F.col("a").alias("u"), F.col("b").alias("v")).union(rest.select("b", "a"))
        parent = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        for _ in range(2):
            over = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            parent = parent.join(over, "p").select("u", F.col("q").alias("p"))
        parent = staged(parent, "parents")
        ends = {x: parent.select(F.col("u").alias(x), F.col("p").alias(f"{x}_")) for x in "ab"}
        moved = rest.join(ends["a"], "a").join(ends["b"], "b").where("a_ <> b_")
        links = staged(moved.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct(), "links")
        if result is None:
            result = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("u").alias("component"), F.col("p").alias("to"))
            result = result.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    if result is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).where("node is not null").distinct()
    return result
