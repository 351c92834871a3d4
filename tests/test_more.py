"""Splits by orders and clusters, running sums, even folds, published tasks, timings and surroundings against plain versions."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from latticework.functions.aggregators import aggregate
from latticework.operators import pairs, relational
from latticework.operators.atom_centred import surroundings
from latticework.operators.shape import kennard_stone_order, match_prototypes
from latticework.plans import bench, clusters, splits
from latticework.shared import running


def test_running_sums(spark):
    r = random.Random(1)
    values = [(i, r.randint(0, 9)) for i in r.sample(range(1000), 200)]
    got = {x.k: (x["rank"], x.before_n) for x in running(spark.createDataFrame(values, "k long, n long").repartition(5), "k", "n").collect()}
    total = 0
    for at, (k, n) in enumerate(sorted(values)):
        assert got[k] == (at, total)
        total += n
    assert running(spark.createDataFrame([], "k long, n long"), "k", "n").count() == 0


@pytest.mark.parametrize("parts", [1000, 2])
def test_even_folds(spark, parts):
    r = random.Random(2)
    groups = [g for g in range(60) for _ in range(r.randint(1, 30) if g > 2 else 90)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "id long, g long")
    got = splits.fold_grouped_even(df, "g", 4, parts)
    by = {x.g: x.fold for x in got.select("g", "fold").distinct().collect()}
    assert len(by) == len(set(groups)) == got.select("g", "fold").distinct().count() and got.count() == len(groups)
    if parts == 1000:
        heap, want = [(0, i) for i in range(4)], {}
        for g in sorted(set(groups), key=lambda g: (-groups.count(g), g)):
            w, i = heapq.heappop(heap)
            want[g] = i
            heapq.heappush(heap, (w + groups.count(g), i))
        assert by == want
    weights = [sum(by[g] == i for g in groups) for i in range(4)]
    assert max(weights) - min(weights) <= 35


def test_orders_as_splits_and_folds(spark):
    rows = [(i, [float(i % 7), float(i * i % 11)], "x") for i in range(40)]
    ordered = kennard_stone_order(spark.createDataFrame(rows, "id long, v array<double>, g string"), "id", "v", "g")
    first = {x.id: x.split for x in splits.split_by_order(ordered, "order", 0.7, 0.1).collect()}
    at = {x.id: x.order for x in ordered.collect()}
    assert all(first[i] == ("train" if at[i] < 28 else "valid" if at[i] < 32 else "test") for i in at)
    back = {x.id: x.split for x in splits.split_by_order(ordered, "order", 0.7, ascending=True).collect()}
    assert all((back[i] == "train") == (39 - at[i] < 28) for i in at)
    folds = [r["n"] for r in splits.fold_by_order(ordered, "order", 3).groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()]
    assert folds == [14, 13, 13]


def test_cluster_folds(spark):
    rows = [(i, [0.0, float(i % 3)]) for i in range(30)] + [(100 + i, [50.0, float(i % 2)]) for i in range(8)] + [(200 + i, [-90.0, 4.0 + i % 2]) for i in range(6)]
    got = clusters.leave_cluster_out_folds(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 3, components=None).collect()
    assert len(got) == 3 * len(rows)
    sizes = {}
    for x in got:
        sizes.setdefault((x.fold, x.split), set()).add(x.cluster)
    # The largest cluster, over half of the rows, trains where it would test.
    for f in range(3):
        assert len(sizes[f, "train"]) + len(sizes[f, "test"]) == 3 and min(len(sizes[f, "train"]), len(sizes[f, "test"])) == 1
        assert sum(x.fold == f and x.split == "train" for x in got) > sum(x.fold == f and x.split == "test" for x in got)


def test_dispatch(spark):
    df = spark.createDataFrame([(i, i % 12, float(i)) for i in range(240)], "id long, g long, y double")
    assert splits.with_split(df, "id", 0.5, 0.25, group="g").groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert splits.with_split(df, "id", 0.5, 0.25, sample_frac=0.5).count() == 120
    assert splits.with_split(df, "id", 0.2, 0.5, by_size=True).where("split = 'train'").count() == 120
    assert splits.with_fold(df, "id", 4, group="g").groupBy("fold").count().where("count <> 60").count() == 0


def test_nan_spoils_plain_aggregates_and_not_masked_ones(spark):
    df = spark.createDataFrame([(1, 2.0), (1, math.nan), (2, 3.0), (2, 5.0)], "k long, x double")
    names = ("sum", "min", "max", "median", "mad")
    plain = {r.k: r for r in aggregate(df, ["k"], "x", names, spoil=True).collect()}
    assert all(math.isnan(plain[1][n]) for n in names) and plain[2]["min"] == 3 and plain[2]["mad"] == 1
    masked = {r.k: r for r in aggregate(df, ["k"], "x", names, F.lit(False)).collect()}
    assert masked[1]["sum"] == 2 and masked[2]["max"] == 5


@pytest.mark.parametrize("name", ["CH4DC_ID", "LogKHCO2_OOD"])
def test_published_tasks_run(spark, name):
    r = random.Random(3)
    rows = [(i, f"h{i % 9}", r.random(), r.random(), r.random()) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, `info.undecorated_scaffold_hash` string, `info.density` double, `outputs.CH4DC` double, `outputs.logKH_CO2` double")
    task = bench.task_of(name, 3)
    plain = {c: c.replace(".", "_") for c in df.columns}
    own = bench.Task(name, task.label.replace(".", "_"), lambda d, k: task.folds(d.withColumnsRenamed({v: k for k, v in plain.items()}), k).withColumnsRenamed(plain), task.k)
    report = bench.run(spark, own, df.withColumnsRenamed(plain), bench.GroupMean(), "id", "mean of all", features="none")
    row = report.first()
    assert row.task == name and len(row.metrics.regression_metrics) == task.k
    times = bench.timings(report).first()
    assert times.fit_timings_mean >= 0 and times.inference_timings_std >= 0


def test_surroundings_and_flat_lists(spark):
    sites = spark.createDataFrame([(1, 0, 0.1, 0.2, 0.3), (1, 1, 0.6, 0.5, 0.4)], "struct_id long, site_id long, x double, y double, z double")
    cell = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    structures = sites.select("struct_id").distinct().withColumn("lattice", cell)
    at = {0: (0.1, 0.2, 0.3), 1: (0.6, 0.5, 0.4)}
    want = sorted(round(d, 9) for s in at for o in at for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4) if (s, 0, 0, 0) != (o, i, j, k) and (d := math.dist(at[s], [a + b for a, b in zip(at[o], (i, j, k))])) <= 1.3)
    assert sorted(round(r.distance, 9) for r in pairs.radius_neighbours(structures, sites, 1.3).collect()) == want
    assert surroundings(structures, sites, 1.3).count() == len(want) + 2
    nested = spark.createDataFrame([([[[1], [2, 3]], [[4]]],)], "x array<array<array<int>>>")
    assert relational.flat(nested, "x").first().x == [1, 2, 3, 4]


def test_prototypes(spark):
    square = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [0.0, 1.0, 0.0]]
    turned = [[2 * y + 3, 2 * -x, 5.0 + z] for x, y, z in square]
    df = spark.createDataFrame([(1, turned), (2, turned[:3])], "k long, xyz array<array<double>>")
    got = {(r.k, r.prototype): r.rmsd for r in match_prototypes(df, [("square", square)], "k").collect()}
    assert got[1, "square"] == pytest.approx(0, abs=1e-6) and got[2, "square"] == 1000
