import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import scalars
from latticework.operators import graph, histogram, pairs, relational, shape, topology
from latticework.plans import metrics
from latticework.shared import quantiles, ranked


def test_ranked_and_quantiles(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).cast("double").alias("v")).repartition(5)
    got = [r.v for r in ranked(df, "v").orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 100
    x = np.array(got)
    assert quantiles(df, "v", (0, 0.3, 0.5, 1)) == pytest.approx([np.quantile(x, q) for q in (0, 0.3, 0.5, 1)])


def test_cells_find_all_pairs(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-3, 3, (60, 3))
    df = spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(p)], "g string, k int, x double, y double, z double")
    got = {(r.k_a, r.k_b) for r in pairs.pairs_within_cutoff(df, "g", "k", 1.5).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if np.linalg.norm(p[i] - p[j]) <= 1.5}


def test_minimum_image_and_replicas(spark):
    one = spark.range(1).select(pairs.lattice_vectors(*[F.lit(x) for x in (10.0, 10.0, 10.0, 90.0, 90.0, 90.0)]).alias("l"), F.array(F.lit(0.1), F.lit(0.0), F.lit(0.0)).alias("a"), F.array(F.lit(0.9), F.lit(0.0), F.lit(0.0)).alias("b"))
    row = one.select(pairs.minimum_image(F.col("l"), F.col("a"), F.col("b")).alias("d"), pairs.replicas(F.col("l"), 28.0).alias("r")).first()
    assert row.d == pytest.approx(2.0) and row.r == [3, 3, 3]
    # Fixed value: the published cell of a cubic framework needs two of each for 28.
    assert spark.range(1).select(pairs.replicas(pairs.lattice_vectors(*[F.lit(x) for x in (26.343, 26.343, 26.343, 90.0, 90.0, 90.0)]), 28.0).alias("r")).first().r == [2, 2, 2]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.5,), (None,)], "x double")
    assert [r.n for r in histogram.histogram(df, [], "x", 0.0, 2.0, 1.0).orderBy("bin").collect()] == [1, 2]
    assert histogram.bin_count(-4, 4, 0.5) == 16 and histogram.bin_count(-40, 0, 1) == 40 and histogram.bin_count(0, 15, 0.5) == 30


def test_walks_and_components(spark):
    edges = graph.both_ways(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "i long, j long"))
    assert {(r.start, r.end) for r in graph.walk_ends(edges, 2).collect()} == {(1, 3), (3, 1), (2, 4), (4, 2)}
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}


def test_long_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert {r.component for r in graph.components(edges).select("component").distinct().collect()} == {0}


def test_fragments_partition(spark):
    sites = spark.createDataFrame([("s", 0, "Cu", True), ("s", 1, "O", False), ("s", 2, "C", False), ("s", 3, "O", False), ("s", 4, "H", False), ("s", 5, "H", False)], "struct_id string, site_id int, symbol string, is_metal boolean")
    bonds = graph.both_ways(spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 4, 5)], "struct_id string, i int, j int"), by=["struct_id"])
    roles = {r.site_id: r.role for r in graph.fragments(sites, bonds).collect()}
    assert roles == {0: "node", 1: "linker", 2: "linker", 3: "floating", 4: "floating", 5: "floating"}
    blocks = {tuple(r.site_ids) for r in graph.fragment_blocks(graph.fragments(sites, bonds), bonds).collect()}
    assert blocks == {(0,), (1, 2), (3,), (4, 5)}


def test_hashes_see_structure_not_names(spark):
    a = [("a", i, "C") for i in range(4)] + [("b", i + 10, "C") for i in range(4)] + [("c", i, "C") for i in range(4)]
    bonds = [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 13, 12), ("b", 12, 11), ("b", 11, 10), ("c", 0, 1), ("c", 0, 2), ("c", 0, 3)]
    edges = graph.both_ways(spark.createDataFrame(bonds, "g string, i int, j int"), by=["g"])
    h = {r.g: r.hash for r in graph.graph_hashes(spark.createDataFrame(a, "g string, node int, label string"), edges, 2, ["g"]).collect()}
    assert h["a"] == h["b"] != h["c"]
    assert {(r.g, r.i, r.j) for r in graph.scaffold(edges, ["g"]).collect()} == {("a", 1, 2), ("a", 2, 1), ("b", 11, 12), ("b", 12, 11)}


def test_kennard_stone():
    # Fixed value: the published order.
    assert shape.kennard_stone(np.array([[1, 2, 3], [4, 5, 6], [8, 8, 9]])).tolist() == [2, 0, 1]
    x = np.random.default_rng(0).normal(size=(30, 3))
    order = shape.kennard_stone(x, scale=False)
    for n in (2, 10, 20):
        rest = [i for i in range(30) if i not in order[:n]]
        d = [min(np.linalg.norm(x[i] - x[j]) for j in order[:n]) for i in rest]
        assert rest[int(np.argmax(d))] == order[n]


def test_superposition_and_shapes(spark):
    p = np.random.default_rng(2).normal(size=(6, 3))
    r, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))
    r *= np.sign(np.linalg.det(r))
    assert shape.superposition_rmsd(p, 2 * p @ r + 5) == pytest.approx(0, abs=1e-6)
    rod = spark.createDataFrame([("r", float(i), 0.0, 0.0) for i in range(5)], "g string, x double, y double, z double")
    row = shape.shape_descriptors(rod, "g").first()
    assert row.npr1 == pytest.approx(0, abs=1e-9) and row.npr2 == pytest.approx(1) and row.rod == pytest.approx(1)


def test_h0_of_a_line(spark):
    df = spark.createDataFrame([("g", float(x), 0.0, 0.0) for x in (0, 1, 3, 7)], "g string, x double, y double, z double")
    assert sorted(r.death for r in topology.h0_diagrams(df, "g").collect()) == [0.5, 1.0, 2.0]


def test_metrics_of_equal_columns(spark):
    df = spark.range(20).select(F.col("id"), F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("p"))
    row = metrics.regression_metrics(df, "y", "p").first()
    assert row.r2_score == 1 and row.mean_absolute_error == 0 and row.max_error == 0
    assert metrics.top_n_in_top_k(df, "id", "y", "p", 2, 1).first().hits == 1 and metrics.top_n_in_top_k(df, "id", "y", "p", 2, 2).first().hits == 2
    assert metrics.top_n_in_top_k(df.withColumn("p", -F.col("p")), "id", "y", "p", 1, 1).first().hits == 0


def test_cleaning(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 1.0), ("b", float("nan"), 1.0)], "k string, `f.x` double, `f.y` double")
    assert relational.drop_nulls(df, "f.").count() == 1
    assert {r.k for r in relational.keep_first(df.select("k", F.col("`f.y`").alias("y")), ["k"], ["y"]).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        relational.expect_rows(df, 2)
    with pytest.raises(FileNotFoundError):
        relational.expect_known(df, df.where("k = 'a'"), "k")
    stem = spark.createDataFrame([("/x/y.z/AB.cif",)], "p string").select(relational.file_stem(F.col("p"))).first()[0]
    assert stem == "AB"


def test_price_texts(spark):
    texts = ["10–20", "Not traded.", "Negative price.", "7"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(scalars.clean_price(F.col("t"))).collect()]
    assert got == [15.0, None, 0.0, 7.0]


def random_graph():
    """A hub with leaves, twins without a hub, a chain, a loop at a node, a node bound to itself only and a random part."""
    rng = np.random.default_rng(6)
    bonds = [(0, i) for i in range(1, 9)] + [(20, 22), (20, 23), (21, 22), (21, 23), (30, 31), (31, 32), (32, 33), (32, 32), (50, 50)]
    return bonds + [(40 + int(a), 40 + int(b)) for a, b in rng.integers(0, 9, (12, 2)) if a != b] + [(8, 30), (33, 40)]


def ends_of(bonds, scope):
    near = {}
    for i, j in bonds:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    out = {x: {x} for x in near}
    for _ in range(scope):
        out = {x: set().union(*(near[y] for y in at)) for x, at in out.items()}
    return {x: at - {x} for x, at in out.items()}


def test_walk_counts_by_classes(spark):
    bonds = random_graph()
    edges = graph.both_ways(spark.createDataFrame(bonds, "i long, j long"))
    start = edges.where("i % 3 < 2").select(F.col("i").alias("start")).distinct()
    got = {(r.scope, r.start): r.n for r in graph.walk_counts(edges, 3, start).collect()}
    assert got == {(s, x): len(at) for s in (1, 2, 3) for x, at in ends_of(bonds, s).items() if x % 3 < 2 and at}
    # A hub is a step: its leaves are one class.
    assert graph.twins(edges)[0].where("node between 1 and 7").select("class").distinct().count() == 1


def test_walk_values_by_classes(spark):
    bonds = random_graph()
    edges = graph.both_ways(spark.createDataFrame(bonds, "i long, j long"))
    node = edges.select(F.col("i").alias("node")).distinct().withColumn("value", F.col("node") % 4)
    start = node.where("node % 3 < 2").select((F.col("node") % 2).alias("block"), F.col("node").alias("start"), "value")
    counted = graph.walk_values(edges, 2, start, node.where("node <> 4"))
    want = {}
    for x, at in ends_of(bonds, 2).items():
        for y in at - {4} if x % 3 < 2 else ():
            want[x % 2, x % 4, y % 4] = want.get((x % 2, x % 4, y % 4), 0) + 1
    assert {(r.block, r.first, r.last): r.n for r in counted.collect()} == want
    got = {(r.combiner, r.pair_agg, r.block_agg): r.value for r in graph.autocorrelations(counted, ("product", "diff"), ("sum", "avg", "max"), ("avg", "sum")).collect()}
    of = {"product": lambda a, b: a * b, "diff": lambda a, b: abs(a - b)}
    over = {"sum": sum, "avg": np.mean, "max": max}
    lists = {c: [[f(a, b) for (k, a, b), n in want.items() if k == block for _ in range(n)] for block in (0, 1)] for c, f in of.items()}
    assert got == pytest.approx({(c, p, b): float(over[b]([over[p](x) for x in lists[c]])) for c in of for p in over for b in ("avg", "sum")})


@pytest.mark.parametrize("sent", [1 << 19, 0])
def test_nodes_of_walks_are_not_sent_to_all_tasks(spark, monkeypatch, sent):
    """However few bytes the nodes of a hub take in a file, joins deal them by their key."""
    plans, keep = [], graph.written
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(graph, "written", lambda df, label: seen(df) or keep(df, label))
    monkeypatch.setattr(graph, "SENT_ROWS", sent)
    bonds = random_graph()
    edges = keep(graph.both_ways(spark.createDataFrame(bonds, "i long, j long")), "edges")
    node = edges.select(F.col("i").alias("node")).distinct()
    start = node.select(F.col("node").alias("start"))
    counts = graph.walk_counts(edges, 2, start)
    values = graph.walk_values(edges, 2, start.select(F.lit(0).alias("block"), "start", F.lit(0).alias("value")), node.withColumn("value", F.lit(1)))
    seen(counts), seen(values)
    assert not [x for p in plans for x in p.splitlines() if "BroadcastHashJoin" in x and re.search(r"\b(node|end)#", x)]
    want = {x: len(at) for x, at in ends_of(bonds, 2).items() if at}
    assert {r.start: r.n for r in counts.where("scope = 2").collect()} == want
    assert [(r.first, r.last, r.n) for r in values.collect()] == [(0, 1, sum(want.values()))]


def test_dealt_scaffold_keeps_its_tasks(spark):
    """A task's rows are told by the number of tasks: no partition is merged with another by its bytes."""
    own = spark.range(4000).select((F.col("id") % 100).alias("g"), (F.col("id") % 7).alias("i"), (10 + F.col("id") % 9).alias("j"))
    plain = graph.scaffold(graph.both_ways(own, by=["g"]), ["g"])
    made = graph.scaffold(graph.both_ways(own, by=["g"], tasks=13), ["g"], 13)
    assert sorted(made.collect()) == sorted(plain.collect())
    assert made.rdd.getNumPartitions() == 13


@pytest.mark.parametrize("sent", [0, 1000])
def test_components_in_many_tasks(spark, monkeypatch, sent):
    """Repeated edges, loops, null ends and a hub, with joins by tasks and by hooks that are sent."""
    monkeypatch.setattr(graph, "COMPONENT_ROWS", 40)
    monkeypatch.setattr(graph, "SENT_ROWS", sent)
    rng = np.random.default_rng(7)
    bonds = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] * 2 + [(500, i) for i in range(400, 430)] + [(7, 7)]
    want = {x: min(_reached(bonds, x)) for x in {x for b in bonds for x in b}} | {900: 900}
    got = graph.components(spark.createDataFrame([*bonds, (900, None), (None, None)], "i long, j long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def _reached(bonds, x):
    seen, new = {x}, {x}
    while new:
        new = {b for a, b in bonds + [(j, i) for i, j in bonds] if a in new} - seen
        seen |= new
    return seen
