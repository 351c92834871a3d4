"""Connected components of a graph given as links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import forget, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every id in a link; component is the smallest id that can be reached.

    Each round hooks every id under its smallest neighbour, flattens the trees by pointer jumping, and
    contracts the graph to the roots, until no link is left. Rounds grow with the logarithm of the
    longest path. Every aggregate is combined before its shuffle, so a hub's links don't meet in one task; the
    plan is the same at every size. Null ids and loops link nothing. An empty input gives an empty result.
    """
    left = written(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"{a} is not null and {b} is not null and hi <> lo").distinct(),
        "links",
        narrow=True,
    )
    nodes = written(left.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().select("node", F.col("node").alias("component")), "nodes", narrow=True)
    while not left.isEmpty():
        up = written(left.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("root")), "hooks", narrow=True)
        moved = True
        while moved:
            over = up.select(F.col("id").alias("mid"), F.col("root").alias("top"))
            jumped = written(up.join(over, up.root == over.mid, "left").select("id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "jump", narrow=True)
            moved = not jumped.where("moved").isEmpty()
            forget(up)
            up = jumped.select("id", "root")
            up.written_at = jumped.written_at
        at = lambda side: up.select(F.col("id").alias(f"{side}_id"), F.col("root").alias(f"{side}_root"))
        before = nodes, left
        nodes = written(nodes.join(at("n"), F.col("component") == F.col("n_id"), "left").select("node", F.coalesce("n_root", "component").alias("component")), "nodes", narrow=True)
        left = left.join(at("h"), F.col("hi") == F.col("h_id"), "left").join(at("l"), F.col("lo") == F.col("l_id"), "left")
        x, y = F.coalesce("h_root", "hi"), F.coalesce("l_root", "lo")
        left = written(left.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).where("hi <> lo").distinct(), "links", narrow=True)
        forget(up, *before)
    forget(left)
    return nodes


def joined_up(label: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """label (node, component), a result of components(), after further links: only the components that these join are followed again."""
    own = lambda c: label.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_component"))
    met = links.join(own("x"), F.col(a) == F.col("x_node"), "left").join(own("y"), F.col(b) == F.col("y_node"), "left")
    joined = components(met.select(F.coalesce("x_component", a).alias("a"), F.coalesce("y_component", b).alias("b")), "a", "b")
    to = joined.select(F.col("node").alias("j_node"), F.col("component").alias("j_component"))
    old = label.join(to, F.col("component") == F.col("j_node"), "left").select("node", F.coalesce("j_component", "component").alias("component"))
    new = joined.join(label.select(F.col("node").alias("l_node")), F.col("node") == F.col("l_node"), "left_anti").select("node", "component")
    out = written(old.union(new), "nodes", narrow=True)
    forget(joined, label)
    return out
