"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v) of type long; nodes share a root exactly if they are connected.

    Each round points every node at the neighbour (or itself) of the lowest hash and contracts the links onto these;
    a star takes two rounds, other shapes shrink by a factor. A hash holds for two rounds and then changes, so that no
    order of the nodes is bad for long. Each round's table is written to the shared folder: lost executors do not
    replay earlier rounds. Null ends and loops are left out.
    """
    edges = links.select("u", "v").filter("u <> v")
    edges = staged(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        salt = F.lit(len(steps) // 2)
        best = F.min(F.struct(F.xxhash64("v", salt).alias("h"), F.col("v").alias("to")))
        own = F.struct(F.xxhash64("u", salt).alias("h"), F.col("u").alias("to"))
        step = staged(edges.groupBy("u").agg(best.alias("b")).select("u", F.least("b", own)["to"].alias("to")), "step")
        steps.append(step)
        a, b = step.select("u", F.col("to").alias("a")), step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        edges = staged(edges.join(a, "u").join(b, "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        out = out.join(step.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
