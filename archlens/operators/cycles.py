"""Cycles of a dependency graph by its strongly connected components, and a witness for each.

Every round colours each node by the least label that reaches it and by the least one that it reaches. Labels are led by a
hash, so that their order has nothing to do with the graph's. Nodes of one component agree in both colours; where both are
the same label, it and the node reach each other, so the component is told. Edges stay only between nodes of equal colours
whose component isn't told yet; what can't lie on a cycle is trimmed, at first until nothing is left of it. Colours run along edges and
jump to the colour of the label found, so a colouring takes about the logarithm of the longest way in steps; as colours
split the graph at many places at once, the number of rounds grows far slower than the number of components that lie one
behind another (8 rings in a chain: 4 rounds, 250 rings: 12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.operators.graph import cyclic_core, written

#: Steps of a colouring between two written tables.
STEPS = 5


def _label(path: Column) -> Column:
    return F.struct(F.xxhash64(path).alias("h"), path.alias("p"))


def _colors(edges: DataFrame, limit: int = 10_000) -> DataFrame:
    """path, f, b: the least labels of the nodes that a way leads from to it, and to from it; itself included. Both ways run in one pass, along the edges and along the turned ones."""
    ways = written(edges.select(F.lit(0).alias("way"), "src", "dst").unionByName(edges.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    colors = ways.select("way", F.col("src").alias("path")).unionByName(ways.select("way", F.col("dst").alias("path"))).distinct().withColumn("color", _label(F.col("path")))
    for _ in range(limit):
        now = colors.withColumn("was", F.col("color"))
        for _ in range(STEPS):
            offered = ways.join(now.select("way", F.col("path").alias("src"), "color"), ["way", "src"]).groupBy("way", F.col("dst").alias("path")).agg(F.min("color").alias("offer"))
            now = now.join(offered, ["way", "path"], "left").select("way", "path", F.least("color", F.coalesce("offer", "color")).alias("color"), "was")
        now = written(now)
        further = now.select("way", F.col("path").alias("p"), F.col("color").alias("further"))
        colors = now.withColumn("p", F.col("color.p")).join(further, ["way", "p"]).select("way", "path", F.least("color", "further").alias("color"))
        if now.where("color <> was").isEmpty():
            return now.groupBy("path").agg(F.min(F.when(F.col("way") == 0, F.col("color"))).alias("f"), F.min(F.when(F.col("way") == 1, F.col("color"))).alias("b"))
    raise RuntimeError(f"colours didn't settle in {limit} steps")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start is some edge's end and whose end is some edge's start."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")


def strong_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> path, component of every node that lies on a cycle; component is the smallest path of those that it reaches and that reach it. A node with an edge to itself alone is a component. Edges with a null end don't count."""
    edges = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    loops, left, told = edges.where("src = dst").select("src"), written(cyclic_core(edges)), []
    while not left.isEmpty():
        both = written(_colors(left))
        told.append(both.where("f = b").select("path", F.col("f").alias("label")))
        open_ = both.where("f <> b").select("path", F.struct("f", "b").alias("class"))
        ends = left.join(open_.select(F.col("path").alias("src"), F.col("class").alias("of_src")), "src").join(open_.select(F.col("path").alias("dst"), F.col("class").alias("of_dst")), "dst")
        left = written(_trimmed(ends.where("of_src = of_dst").select("src", "dst")))
    if not told:
        return edges.select(F.col("src").alias("path"), F.col("src").alias("component")).limit(0)
    found = told[0]
    for more in told[1:]:
        found = found.unionByName(more)
    names = found.groupBy("label").agg(F.min("path").alias("component"), F.count("*").alias("n"))
    named = found.join(names, "label")
    several = named.where("n > 1").select("path", "component")
    alone = named.where("n = 1").join(loops.select(F.col("src").alias("path")), "path", "left_semi").select("path", "component")
    return written(several.unionByName(alone))


def witnesses(inner: DataFrame) -> DataFrame:
    """inner(component, src, dst), the edges within components -> component, witness: the shortest cycle from the component's smallest node back to it, of several the first in order of its names. A breadth-first search of all components at once, with as many steps as the longest witness has edges."""
    inner = written(inner)
    front = inner.select("component", F.col("component").alias("src"), F.array("component").alias("trail")).distinct()
    seen, closed = front.select("component", "src"), inner.select("component", F.array("src").alias("witness")).limit(0)
    while True:
        reached = inner.join(front, ["component", "src"]).groupBy("component", F.col("dst").alias("src")).agg(F.min("trail").alias("trail"))
        ended = F.max(F.col("src") == F.col("component")).over(Window.partitionBy("component"))  # a component is small beside the graph, and its front smaller
        steps = reached.withColumns({"trail": F.concat("trail", F.array("src")), "_ended": ended}).join(seen, ["component", "src"], "left_anti").unionByName(
            reached.where("src = component").select("component", "src", F.concat("trail", F.array("src")).alias("trail"), F.lit(None).cast("boolean").alias("_ended"))
        )
        steps = written(steps.where("_ended IS NULL OR NOT _ended"))
        closed = closed.unionByName(steps.where("_ended IS NULL").select("component", F.col("trail").alias("witness")))
        front = steps.where("_ended IS NOT NULL").select("component", "src", "trail")
        if front.isEmpty():
            return closed
        seen = seen.unionByName(front.select("component", "src"))


def dependency_cycles(edges: DataFrame) -> DataFrame:
    """component, n_nodes, n_edges within, n_cycles (independent ones: edges less nodes plus one), witness (closed: its first node is its last)."""
    members = strong_components(edges)
    of = lambda end: members.select(F.col("path").alias(end), F.col("component").alias(f"of_{end}"))
    inner = edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst").select(F.col("of_src").alias("component"), "src", "dst")
    inner = written(inner)
    counts = members.groupBy("component").agg(F.count("*").alias("n_nodes")).join(inner.groupBy("component").agg(F.count("*").alias("n_edges")), "component")
    return counts.join(witnesses(inner), "component").select("component", "n_nodes", "n_edges", (F.col("n_edges") - F.col("n_nodes") + 1).alias("n_cycles"), "witness")
