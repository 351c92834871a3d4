"""Bond graphs as edge tables: walks, components, refinement hashes, fragments and autocorrelations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.aggregators import AGGREGATORS, COMBINERS
from latticework.shared import dealt, written


#: Rows of a task of components(), and of the hooks or nodes that are sent to all tasks.
COMPONENT_ROWS, SENT_ROWS = 1 << 18, 1 << 19


def both_ways(edges: DataFrame, a: str = "i", b: str = "j", by: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Edges and their opposites once each. tasks: they are dealt to as many by their first node."""
    by = by or []
    both = edges.select(*by, a, b).union(edges.select(*by, F.col(b).alias(a), F.col(a).alias(b)))
    return (dealt(both, tasks, *by, a) if tasks else both).distinct()


def walk_ends(edges: DataFrame, scope: int, by: list[str] | None = None, start: DataFrame | None = None) -> DataFrame:
    """(by, start, end): the ends of walks of `scope` bonds without the start itself. edges (by, i, j) go both ways.

    One equi-join a step, distinct after each, so that a frontier never holds a pair twice.
    """
    by = by or []
    step = edges.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("i").alias("__i"), F.col("j").alias("__j"))
    at = (start if start is not None else edges.select(*by, F.col("i").alias("start")).distinct()).withColumn("end", F.col("start"))
    for _ in range(scope):
        at = at.join(step, [F.col(c) == F.col(f"__{c}") for c in by] + [F.col("end") == F.col("__i")]).select(*by, "start", F.col("__j").alias("end")).distinct()
    return at.where("start <> end")


def twins(edges: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """(node, class) and (a, b): nodes with the same neighbours are of one class, and the steps between classes; how to join what has a row a class. edges (i, j) go both ways and are distinct.

    If one node of a class is bound to one of another, then all are to all, so that walks of classes are walks of their nodes. A hub's leaves are
    one class. A class is told by 128 bits and the number of its neighbours. For the same reason the steps are the edges between one node of each class.
    """
    sign = edges.groupBy(F.col("i").alias("node")).agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("j")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "j")).alias("y")).alias("class"))
    nodes = written(sign, "twins")
    one = written(nodes.groupBy("class").agg(F.min("node").alias("one")), "ones")
    sent = F.broadcast if one.count() <= SENT_ROWS else _kept_apart
    to = lambda c, side: sent(one.select(F.col("class").alias(c), F.col("one").alias(f"one_{side}")))
    steps = edges.join(to("a", "i"), F.col("i") == F.col("one_i")).join(to("b", "j"), F.col("j") == F.col("one_j")).select("a", "b").distinct()
    return nodes, written(steps, "steps"), sent


def _kept_apart(df: DataFrame) -> DataFrame:
    """df, which a join deals to tasks by its key. Sorted ids take so few bytes in a file that Spark would send a million of them to every task."""
    return df.hint("merge")


def classed(df: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """df with the class of its nodes, written."""
    return written(df.join(_kept_apart(nodes), F.col(key) == F.col("node")).drop("node"), "classed")


def class_walks(steps: DataFrame, start: DataFrame, scope: int) -> list[DataFrame]:
    """(first, last) for each number of bonds up to scope: the classes of the ends of walks from the classes of start (class)."""
    at = start.select(F.col("class").alias("first"), F.col("class").alias("last")).distinct()
    out = []
    for _ in range(scope):
        at = written(at.join(steps, F.col("last") == F.col("a")).select("first", F.col("b").alias("last")).distinct(), "walks")
        out.append(at)
    return out


def walk_counts(edges: DataFrame, scope: int, start: DataFrame) -> DataFrame:
    """(scope, start, n): the number of ends of walks of 1 to `scope` bonds, without the start itself. Starts without another end have no row.

    Ends are counted by classes of nodes with the same neighbours: a hub is one step and not one for each two of its leaves.
    """
    nodes, steps, sent = twins(edges)
    size = nodes.groupBy(F.col("class").alias("sized")).agg(F.count("*").alias("size"))
    own = classed(start.select("start"), "start", nodes).withColumnRenamed("class", "mine")
    outs = []
    for n, walks in enumerate(class_walks(steps, own.select(F.col("mine").alias("class")), scope), 1):
        many = walks.join(size, F.col("last") == F.col("sized")).groupBy("first").agg((F.sum("size") - F.max((F.col("first") == F.col("last")).cast("int"))).alias("n")).where("n > 0")
        outs.append(own.join(sent(many), F.col("mine") == F.col("first")).select(F.lit(n).alias("scope"), "start", "n"))
    return reduce(DataFrame.union, outs)


def walk_values(edges: DataFrame, scope: int, start: DataFrame, ends: DataFrame) -> DataFrame:
    """(block, first, last, n): how many walks of `scope` bonds, told apart by their two ends, lead from a value to a value.

    start: (block, start, value) and ends: (node, value), with one value a node; walks back to the start don't count. Nodes of a class with equal values are counted together.
    """
    nodes, steps, _ = twins(edges)
    mine = classed(start.select("start", "block", F.col("value").alias("v")), "start", nodes)
    its = classed(ends.select(F.col("node").alias("end"), F.col("value").alias("w")), "end", nodes).withColumnRenamed("class", "d")
    walks = class_walks(steps, mine, scope)[-1]
    mine = mine.withColumnRenamed("class", "c")
    a, b = mine.groupBy("block", "v", "c").agg(F.count("*").alias("n")), its.groupBy("w", "d").agg(F.count("*").alias("m"))
    all_ = walks.join(a, F.col("first") == F.col("c")).join(b, F.col("last") == F.col("d")).select("block", "v", "w", (F.col("n") * F.col("m")).alias("n"))
    back = walks.where(F.col("first") == F.col("last")).select(F.col("first").alias("same"))
    back = mine.join(_kept_apart(its), F.col("start") == F.col("end")).join(back, F.col("c") == F.col("same")).select("block", "v", "w", F.lit(-1).cast("long").alias("n"))
    return all_.union(back).groupBy("block", F.col("v").alias("first"), F.col("w").alias("last")).agg(F.sum("n").alias("n")).where("n > 0")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (i, j): the smallest node that can be reached. Hooking and pointer jumping; logarithmically many rounds.

    Rows are dealt by key to a number of tasks that grows with them, not by their bytes. Hooks that are few are sent to all tasks: when most nodes
    have one root, what is asked for that root does not meet in one of them.
    """
    own = written(edges.select("i", "j"), "edges")
    tasks = lambda df: -(-df.count() // COMPONENT_ROWS) or 1
    left = own.select(F.greatest("i", "j").alias("hi"), F.least("i", "j").alias("lo")).where("hi <> lo")
    nodes = own.select(F.col("i").alias("node")).union(own.select("j")).where("node is not null")
    nodes = written(dealt(nodes, 2 * tasks(own), "node").distinct().withColumn("component", F.col("node")), "nodes")
    n = tasks(own)

    def met(df: DataFrame, key: str, right: DataFrame, other: str, few: bool, count: int) -> DataFrame:
        x, y = (df, F.broadcast(right)) if few else (dealt(df, count, key), dealt(right, count, other))
        return x.join(y, F.col(key) == F.col(other), "left")

    while not left.isEmpty():
        up = written(dealt(left, n, "hi").groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("root")), "hooks")
        many, moved = up.count(), True
        few, some = many <= SENT_ROWS, -(-many // COMPONENT_ROWS) or 1
        while moved:
            over = up.select(F.col("id").alias("mid"), F.col("root").alias("top"))
            jumped = written(met(up, "root", over, "mid", few, some).select("id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "jump")
            moved, up = not jumped.where("moved").isEmpty(), jumped.select("id", "root")
        to = lambda c: up.select(F.col("id").alias(f"{c}_id"), F.col("root").alias(f"{c}_root"))
        nodes = written(met(nodes, "component", to("n"), "n_id", few, tasks(nodes)).select("node", F.coalesce("n_root", "component").alias("component")), "nodes")
        left = met(met(left, "hi", to("h"), "h_id", few, n), "lo", to("l"), "l_id", few, n)
        x, y = F.coalesce("h_root", "hi"), F.coalesce("l_root", "lo")
        left = written(dealt(left.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).where("hi <> lo"), n, "hi", "lo").distinct(), "edges")
        n = tasks(left)
    return nodes


def refine(labels: DataFrame, edges: DataFrame, rounds: int, by: list[str] | None = None) -> DataFrame:
    """(by, node, label): md5 of the own label and the sorted labels of the neighbours, `rounds` times over.

    Equal labels of a node's neighbours are counted before they meet, so that a hub brings a row for each label and not for each bond.
    """
    by = by or []
    own = labels
    for _ in range(rounds):
        right = own.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("node").alias("__node"), F.col("label").alias("__label"))
        met = edges.join(right, [F.col(c) == F.col(f"__{c}") for c in by] + [F.col("j") == F.col("__node")])
        near = met.groupBy(*by, "i", "__label").agg(F.count("*").cast("int").alias("__n"))
        near = near.groupBy(*by, "i").agg(_spelled("__label", "__n").alias("__near"))
        near = near.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("i").alias("_i"), "__near")
        own = own.join(near, [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("node") == F.col("_i")], "left")
        own = own.select(*by, "node", F.md5(F.concat("label", F.lit("|"), F.coalesce("__near", F.lit("")))).alias("label"))
    return own


def graph_hashes(labels: DataFrame, edges: DataFrame, rounds: int, by: list[str]) -> DataFrame:
    """One hash a graph: md5 of the sorted refined labels. Undecorated graphs have equal labels, scaffolds lack their leaves (see scaffold)."""
    counted = refine(labels, edges, rounds, by).groupBy(*by, "label").agg(F.count("*").cast("int").alias("__n"))
    return counted.groupBy(*by).agg(F.md5(_spelled("label", "__n")).alias("hash"))


def _spelled(label: str, n: str) -> Column:
    """The sorted labels, each as often as it was counted, joined by commas."""
    return F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(label, n))), lambda x: F.array_repeat(x.getField(label), x.getField(n)))), ",")


def scaffold(edges: DataFrame, by: list[str], tasks: int | None = None) -> DataFrame:
    """The edges without those of nodes that have one neighbour. tasks: as in both_ways(), whose dealing is kept."""
    own = dealt(edges, tasks, *by, "i") if tasks else edges
    degree = own.groupBy(*by, "i").agg(F.count("*").alias("degree"))
    leaf = degree.where("degree = 1").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("i").alias("_i"))
    on = lambda side: [F.col(c) == F.col(f"_{c}") for c in by] + [F.col(side) == F.col("_i")]
    left = own.join(leaf, on("i"), "left_anti")
    return (dealt(left, tasks, *by, "j") if tasks else left).join(leaf, on("j"), "left_anti")


def fragments(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """(struct_id, site_id, role): node, linker or floating.

    A metal is a node, and so is a site bound to metals and hydrogens only. Floating are the components
    without a metal; linkers are all others. sites: struct_id, site_id, symbol, is_metal; edges: struct_id, i, j both ways.
    """
    keyed = edges.select(F.concat_ws("#", "struct_id", "i").alias("i"), F.concat_ws("#", "struct_id", "j").alias("j"))
    part = components(keyed)
    own = sites.withColumn("__k", F.concat_ws("#", "struct_id", "site_id")).join(part, F.col("__k") == F.col("node"), "left").withColumn("__c", F.coalesce("component", "__k"))
    metal = own.groupBy("__c").agg(F.max(F.col("is_metal").cast("int")).alias("__has")).withColumnRenamed("__c", "__cc")
    far = sites.select(F.col("struct_id").alias("_s"), F.col("site_id").alias("_j"), (F.col("is_metal") | (F.col("symbol") == "H")).alias("_mh"), F.col("is_metal").alias("_m"))
    bound = edges.join(far, (F.col("struct_id") == F.col("_s")) & (F.col("j") == F.col("_j"))).groupBy(F.col("struct_id").alias("_s"), F.col("i").alias("_i")).agg(F.min(F.col("_mh").cast("int")).alias("_only"), F.max(F.col("_m").cast("int")).alias("_any"))
    own = own.join(metal, F.col("__c") == F.col("__cc")).join(bound, (F.col("struct_id") == F.col("_s")) & (F.col("site_id") == F.col("_i")), "left")
    role = F.when(F.col("__has") == 0, "floating").when(F.col("is_metal") | ((F.col("_only") == 1) & (F.col("_any") == 1)), "node").otherwise("linker")
    return own.select("struct_id", "site_id", "symbol", role.alias("role"))


def fragment_blocks(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """(struct_id, role, frag_id, site_ids): connected sites of one role are a block."""
    side = lambda s: roles.select(F.col("struct_id").alias(f"{s}s"), F.col("site_id").alias(f"{s}i"), F.col("role").alias(f"{s}r"))
    same = edges.join(side("a"), (F.col("struct_id") == F.col("as")) & (F.col("i") == F.col("ai"))).join(side("b"), (F.col("struct_id") == F.col("bs")) & (F.col("j") == F.col("bi"))).where("ar = br")
    part = components(same.select(F.concat_ws("#", "struct_id", "i").alias("i"), F.concat_ws("#", "struct_id", "j").alias("j")))
    own = roles.withColumn("__k", F.concat_ws("#", "struct_id", "site_id")).join(part, F.col("__k") == F.col("node"), "left")
    return own.groupBy("struct_id", "role", F.coalesce("component", "__k").alias("frag_id")).agg(F.array_sort(F.collect_list("site_id")).alias("site_ids"))


#: Aggregates of values x that are there n times.
COUNTED: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda x, n: F.sum(x * n),
    "avg": lambda x, n: F.sum(x * n) / F.sum(F.when(x.isNotNull(), n)),
    "max": lambda x, n: F.max(x),
    "min": lambda x, n: F.min(x),
    "range": lambda x, n: F.max(x) - F.min(x),
}


def autocorrelations(counted: DataFrame, combiners: tuple[str, ...], over_pairs: tuple[str, ...], over_blocks: tuple[str, ...]) -> DataFrame:
    """(combiner, pair_agg, block_agg, value): properties combined over walks, aggregated in blocks, then over them. counted: as from walk_values()."""
    spread = lambda names, make, alias: F.explode(F.array(*[F.struct(F.lit(n).alias(alias), make(n).alias("value")) for n in names]))
    a, b = F.col("first").cast("double"), F.col("last").cast("double")
    long = counted.select("block", "n", spread(combiners, lambda n: COMBINERS[n](a, b), "combiner").alias("c")).select("block", "n", "c.combiner", "c.value")
    inner = long.groupBy("block", "combiner").agg(*[COUNTED[n](F.col("value"), F.col("n")).cast("double").alias(n) for n in over_pairs])
    inner = inner.select("block", "combiner", spread(over_pairs, lambda n: F.col(f"`{n}`"), "pair_agg").alias("p")).select("block", "combiner", "p.pair_agg", "p.value")
    outer = inner.groupBy("combiner", "pair_agg").agg(*[AGGREGATORS[n](F.col("value")).cast("double").alias(n) for n in over_blocks])
    return outer.select("combiner", "pair_agg", spread(over_blocks, lambda n: F.col(f"`{n}`"), "block_agg").alias("b")).select("combiner", "pair_agg", "b.block_agg", "b.value")


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.groupBy(*by, "i").agg(F.count("*").alias("degree"))


def topology_value(scope: int, neighbours: Column, degree: Column) -> Column:
    """The property T of a walk: the number of ends from a start, and the degree of the end."""
    return F.when(F.lit(scope) > 0, neighbours * degree)
