"""All pairs by tiles: the same as by brute force, whatever the blocks, and nothing as long as the pairs leaves a tile."""

import math
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from latticework.operators import featurizers, pairs, tiles


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 7)


def vectors():
    """Three groups, one with copies, and rows that have no distance: no vector, a null in it, no group or no key."""
    rng = np.random.default_rng(4)
    rows = [(g, f"k{i}", [float(x) for x in rng.normal(size=4)], i % 5) for g, n in (("a", 40), ("b", 11)) for i in range(n)]
    rows += [("c", f"c{i}", [0.25, 0.5, 0.0, 1.0 + (i == 5)], i) for i in range(6)]
    return rows + [("a", "n1", None, 1), ("a", "n2", [1.0, None, 1.0, 1.0], 1), (None, "n3", [0.0] * 4, 1), ("b", None, [0.0] * 4, 1), ("d", "alone", [0.0] * 4, 1)]


SCHEMA = "g string, k string, e array<double>, p long"


def brute(g):
    own = [r for r in vectors() if r[0] == g and r[1] is not None and r[2] is not None and None not in r[2]]
    return [(x, y, math.dist(x[2], y[2])) for x, y in combinations(sorted(own, key=lambda r: r[1]), 2)]


def test_weighted_histogram_of_pairs(spark, small_blocks):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    got = {(r.g, r.combiner, r.bin): r.weight for r in pairs.weighted_pair_histogram(df, "g", "k", "e", "p", ("product", "first"), [0.5, 2.0], 3.0, 3.0, 0.2).collect()}
    of = {"product": lambda x, y: x * y, "first": lambda x, y: x}
    want = {(g, c, i): math.fsum(of[c](x[3], y[3]) * math.exp(-3 * (d - m) ** 2) for x, y, d in brute(g) if 0.2 < d < 3) for g in "abc" for c in of for i, m in enumerate((0.5, 2.0))}
    assert got == pytest.approx(want)


def test_box_side_of_many_blocks(spark, small_blocks):
    odd = [("e", "x", [math.nan] + [0.0] * 3, 0), ("e", "y", [1.0] * 4, 0), ("f", "x", None, 0), ("f", "y", [1.0] * 4, 0), ("h", "x", [1e200] + [0.0] * 3, 0), ("h", "y", [0.0] * 4, 0)]
    got = {r.g: r.side for r in pairs.box_side(spark.createDataFrame(vectors() + odd, SCHEMA).repartition(3), "g", "k", "e").collect()}
    assert math.isnan(got.pop("e")) and got.pop("f") is None and got.pop("h") == math.inf
    assert got == pytest.approx({g: max(d for _, _, d in brute(g)) for g in "abc"})


def test_nearest_of_many_blocks(spark, small_blocks):
    got = {}
    for r in pairs.nearest_neighbours(spark.createDataFrame(vectors(), SCHEMA).repartition(3), "g", "k", "e", 4).collect():
        got.setdefault((r.g, r.k), []).append((r["rank"], r.distance))
    for g in "abc":
        keys = {r[1] for r in vectors() if r[0] == g and r[1] is not None}
        for k in keys:
            want = (sorted(d for x, y, d in brute(g) if k in (x[1], y[1])) + [None] * (len(keys) - 1))[:4]
            rows = sorted(got.pop((g, k)))
            assert [r for r, _ in rows] == [1, 2, 3, 4]
            assert [d for _, d in rows] == [x if x is None else pytest.approx(x) for x in want]
    assert set(got) == {("d", "alone")} or not got


def test_histogram_of_pairs(spark, small_blocks):
    # At distances 0.5 and 1.0 a pair is of the bin above, and at the end of none.
    odd = [("e", f"x{i}", [x, 3.0, 3.0, 3.0], 0) for i, x in enumerate((0.0, 0.5, 1.0, 2.0))] + [("f", "x", None, 0), ("f", "y", [1.0] * 4, 0)]
    got = {(r.g, r.bin): r.n for r in pairs.pair_histogram(spark.createDataFrame(vectors() + odd, SCHEMA).repartition(3), "g", "k", "e", 0.0, 2.0, 0.5).collect()}
    want = {(g, i): sum(i * 0.5 <= d < (i + 1) * 0.5 for _, _, d in brute(g)) for g in "abc" for i in range(4)}
    assert got == want | {("e", 0): 0, ("e", 1): 2, ("e", 2): 2, ("e", 3): 1} | {("f", i): 0 for i in range(4)}


def test_statistics_of_pairs(spark, small_blocks):
    odd = [("e", "x", [math.nan] + [0.0] * 3, 0), ("e", "y", [1.0] * 4, 0), ("e", "z", [2.0] * 4, 0), ("f", "x", None, 0), ("f", "y", [1.0] * 4, 0)] + [("h", f"h{i}", [float(i > 0) * 1e7, 0.0, 0.0, i / 1000], 0) for i in range(3)]
    got = {r.g: r[1:] for r in pairs.pair_statistics(spark.createDataFrame(vectors() + odd, SCHEMA).repartition(3), "g", "k", "e").collect()}
    assert got.pop("e") == (2.0, 0.0, 2.0, 2.0) and got.pop("f") == (None,) * 4
    far = [math.dist((0, 0), (1e7, 0.001)), math.dist((0, 0), (1e7, 0.002)), 0.001]
    assert got.pop("h") == pytest.approx((np.mean(far), np.std(far), max(far), min(far)), rel=1e-9)
    assert set(got) == set("abc")
    for g, row in got.items():
        d = [x for _, _, x in brute(g)]
        assert row == pytest.approx((np.mean(d), np.std(d), max(d), min(d)))


def test_contacts_of_roles(spark, small_blocks):
    """A row may have both roles, and a null one; equal keys meet too."""
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    got = {r.g: (r.n, r.weight) for r in pairs.cross_contacts(df, "g", "k", "e", (F.nullif(F.col("p"), F.lit(3)) <= 1, F.col("p") != 0), 2.0).collect()}
    own = [r for r in vectors() if None not in r[:3] and None not in r[2]]
    d = {g: [x for r in own for s in own if r[0] == s[0] == g and r[3] <= 1 and s[3] != 0 and (x := math.dist(r[2], s[2])) < 2] for g in "abcd"}
    assert got == {g: (len(x), pytest.approx(math.fsum(math.exp(-v) for v in x))) for g, x in d.items()}


def periodic(spark):
    """Sites of two structures with skewed cells, some of them far outside of it, one without a property."""
    rng = np.random.default_rng(5)
    cells = {"s": [[3.0, 0.0, 0.0], [1.0, 2.5, 0.0], [-0.5, 0.75, 4.0]], "t": [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 2.0]]}
    rows = [(s, i, "AB"[i % 2], *[float(x) for x in rng.uniform(-0.2, 1.2, 3)]) for s, n in (("s", 30), ("t", 4)) for i in range(n)] + [("s", 99, "?", 0.0, 0.0, 0.0)]
    sites = spark.createDataFrame(rows, "struct_id string, site_id int, symbol string, fx double, fy double, fz double").repartition(3)
    return sites, spark.createDataFrame(list(cells.items()), "struct_id string, lattice array<array<double>>"), rows, cells


def brute_images(rows, cells, pick):
    """Weights of the bins 0.25 wide between 0.2 and 3.0, of property products by the nearest of 27 images."""
    of, out = {"A": 2.0, "B": 3.0}, {}
    for x in rows:
        for y in rows:
            if x[0] == y[0] and pick(x, y) and x[2] in of and y[2] in of:
                d = min(np.linalg.norm((np.array(y[3:]) - x[3:] + (i, j, k)) @ np.array(cells[x[0]])) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))
                if 0.2 < d < 3:
                    b = min(int((d - 0.2) // 0.25), 10)
                    name = (x[0], f"aprdf_X_product_{b}")
                    out[name] = out.get(name, 0) + of[x[2]] * of[y[2]] * math.exp(-10 * (d - 0.2 - b * 0.28) ** 2)
    return out


PROPERTIES = ([("A", 2.0), ("B", 3.0)], "symbol string, X double")


def test_nearest_images_of_skewed_cells(spark, small_blocks):
    sites, structures, rows, cells = periodic(spark)
    made = featurizers.aprdf(structures, sites, spark.createDataFrame(*PROPERTIES), ("X",), ("product",), 3.0, 0.2, 0.25, 10.0)
    got = {(r.struct_id, r.feature): r.value for r in made.long().where("value <> 0").collect()}
    assert got == pytest.approx(brute_images(rows, cells, lambda x, y: x[1] < y[1]))


def test_nearest_images_of_guests_and_hosts(spark, small_blocks):
    sites, structures, rows, cells = periodic(spark)
    # A host that stands twice in the same place counts twice.
    sites, rows = sites.union(sites.where("struct_id = 't' and site_id = 3")), rows + [r for r in rows if r[:2] == ("t", 3)]
    roles = sites.withColumn("role", F.when(F.col("site_id") % 3 == 0, "host").otherwise("guest")).where("site_id % 3 < 2").drop("site_id")
    made = featurizers.guest_aprdf(structures, roles, spark.createDataFrame(*PROPERTIES), ("X",), ("product",), 3.0, 0.2, 0.25, 10.0)
    got = {(r.struct_id, r.feature): r.value for r in made.long().where("value <> 0").collect()}
    assert got == pytest.approx(brute_images(rows, cells, lambda x, y: x[1] % 3 == 1 and y[1] % 3 == 0))


def test_nearest_images_far_from_a_cell_at_right_angles():
    """Positions far outside differ by what they differ, however large they are; a turned cell has right angles too."""
    rng = np.random.default_rng(7)
    far = np.array([[3e8, -2e8, 0], [0, 0, 1e7]])[rng.integers(0, 2, 40)]
    x, y = rng.uniform(-0.5, 0.5, (40, 3)), rng.uniform(-0.5, 0.5, (30, 3))
    x, y = x + far, y + far[:30]
    for cell in (np.diag([4.0, 3.0, 0.7]), np.array([[3.0, 4.0, 0.0], [-4.0, 3.0, 0.0], [0.0, 0.0, 2.0]])):
        near = tiles.Images(x, y, cell)
        i, j = np.meshgrid(np.arange(40), np.arange(30), indexing="ij")
        assert near.between(slice(0, 40), slice(0, 30), None).ravel() == pytest.approx(near.exact(i.ravel(), j.ravel()), rel=1e-12, abs=1e-12)


def test_odd_rows_of_guests_and_hosts_as_in_sql(spark, tmp_path):
    """Rows with no label have no role; those with fewer numbers than a position has, or odd ones, have no distance."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(scale=0.2, size=4)], int(i % 3)) for i in range(600)]
    rows += [(600, [0.1] * 4, None), (650, [0.1, 0.2], 0), (700, [], 1), (750, None, 0), (800, [math.nan] * 4, 1), (850, [math.inf] * 4, 0), (900, [0.1, None, 0.1, 0.1], 1)]
    rows += [(950 + 50 * i, [1e8, float(np.float32(i / 7)), 0.25, 0.0], i % 2) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = {(r.struct_id, r.feature): r.value for r in entry.queries()["guest_aprdf"](spark, str(tmp_path)).collect()}
    want = {(s, f): v for s, f, v in con.execute(entry.oracle_sql()["guest_aprdf"]).fetchall()}
    assert len(want) > 200 and got == pytest.approx(want, abs=1.1e-6)


def test_totals_of_neighbours_are_those_of_their_rows(spark, small_blocks):
    sites, structures, _, _ = periodic(spark)
    sites = sites.select("struct_id", "site_id", (F.col("fx") * 3).alias("x"), (F.col("fy") * 5).alias("y"), F.when(F.col("site_id") != 7, F.col("fz") * 2).alias("z"))
    sites = sites.union(sites.where("site_id = 3"))
    want = {(r.struct_id, r.site_id): (r.n, pytest.approx(r.total)) for r in pairs.radius_neighbours(structures, sites, 2.0).groupBy("struct_id", "site_id").agg(F.count("*").alias("n"), F.sum("distance").alias("total")).collect()}
    got = {(r.struct_id, r.site_id): (r.n, r.total) for r in pairs.radius_totals(structures, sites, 2.0).collect()}
    assert len(got) > 30 and got == want
