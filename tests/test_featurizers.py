import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import featurizers, graph, molecules
from latticework.sources import force_field, sinks

CELL = [[5.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 5.0]]


@pytest.fixture(scope="module")
def crystal(spark):
    structures = spark.createDataFrame([("s", CELL), ("t", CELL)], "struct_id string, lattice array<array<double>>")
    rows = [("s", 0, "Cu", 0.0, 0.0, 0.0, 1.2), ("s", 1, "O", 0.5, 0.0, 0.0, -0.6), ("s", 2, "C", 0.5, 0.5, 0.0, 0.1), ("t", 0, "O", 0.9, 0.0, 0.0, -1.0)]
    sites = spark.createDataFrame([(*r, r[3] * 5, r[4] * 5, r[5] * 5) for r in rows], "struct_id string, site_id int, symbol string, fx double, fy double, fz double, charge double, x double, y double, z double")
    properties = spark.createDataFrame([("Cu", 1.9, 3.0), ("O", 3.44, 1.0), ("C", 2.55, 2.0)], "symbol string, X double, mod_pettifor double")
    return structures, sites, properties


def test_aprdf(crystal):
    structures, sites, properties = crystal
    made = featurizers.aprdf(structures, sites, properties, ("X", "mod_pettifor"))
    got = {r.struct_id: np.array(r.features) for r in made.df.collect()}
    assert len(made.labels) == len(got["s"]) == 432 and not got["t"].any()
    want = np.zeros((2, 3, 72))
    centres, p = np.linspace(2, 20, 72), {0: (1.9, 3.0), 1: (3.44, 1.0), 2: (2.55, 2.0)}
    for i, j, d in ((0, 1, 2.5), (1, 2, 2.5), (0, 2, 2.5 * 2**0.5)):
        b = int((d - 2) // 0.25)
        for k in range(2):
            x, y = p[i][k], p[j][k]
            for c, v in enumerate(((x + y) / 2, x * y, abs(y - x))):
                want[k, c, b] += v * np.exp(-10 * (d - centres[b]) ** 2)
    assert got["s"] == pytest.approx(want.ravel())


def test_amd_of_a_simple_cube(crystal):
    structures, sites, _ = crystal
    made = featurizers.amd(structures, sites.where("struct_id = 't'"), k=8, types=("O", "F-Cl"), reach=12.0)
    got = {r.struct_id: r.features for r in made.df.collect()}
    assert got["t"][:8] == pytest.approx([5.0] * 6 + [5 * 2**0.5] * 2) and got["t"][8:16] == [None] * 8 and got["t"][16:] == got["t"][:8]
    assert len(made.labels) == 24 and got["s"] == [None] * 24


def test_amd_reaches_every_rank(spark):
    """A skewed cell and a sparse type in a large one, whose neighbours lie beyond reach, against brute force."""
    cells = {"skew": [[4.0, 0.0, 0.0], [3.4, 2.0, 0.0], [3.4, 1.0, 1.8]], "large": [[25.0, 0.0, 0.0], [0.0, 28.0, 0.0], [5.0, 0.0, 31.0]]}
    frac = {"skew": [(0.05, 0.1, 0.0), (0.9, 0.8, 0.95)], "large": [(0.1, 0.1, 0.1), (0.2, 0.15, 0.1)]}
    rows = [(s, i, "O", *map(float, np.array(f) @ np.array(cells[s]))) for s in cells for i, f in enumerate(frac[s])]
    structures = spark.createDataFrame(list(cells.items()), "struct_id string, lattice array<array<double>>")
    sites = spark.createDataFrame(rows, "struct_id string, site_id int, symbol string, x double, y double, z double")
    made = featurizers.amd(structures, sites, k=30, types=("O",), every=False, reach=8.0)
    shifts = np.array(np.meshgrid(*[np.arange(-12, 13)] * 3)).reshape(3, -1).T
    for r in made.df.collect():
        at = np.array([x[3:] for x in rows if x[0] == r.struct_id])
        images = (at[None] + (shifts @ np.array(cells[r.struct_id]))[:, None]).reshape(-1, 3)
        want = np.mean([np.sort(np.linalg.norm(images - a, axis=1))[1:31] for a in at], axis=0)
        assert r.features == pytest.approx(want)


def test_racs(spark, crystal):
    _, sites, properties = crystal
    bonds = graph.both_ways(spark.createDataFrame([("s", 0, 1), ("s", 1, 2)], "struct_id string, i int, j int"), by=["struct_id"])
    blocks = spark.createDataFrame([("s", "nodes", "n", [0]), ("s", "linker_all", "l", [1, 2])], "struct_id string, role string, frag_id string, site_ids array<int>")
    made = featurizers.racs(sites, bonds, blocks, properties)
    assert len(made.labels) == 480
    got = {r.struct_id: dict(zip(made.labels, r.features)) for r in made.df.collect()}
    s = got["s"]
    assert s["racs_nodes_X_scope-1_propagg-product_corragg-sum_bbagg-avg"] == pytest.approx(1.9 * 3.44)
    assert s["racs_nodes_X_scope-2_propagg-diff_corragg-avg_bbagg-sum"] == pytest.approx(0.65)
    assert s["racs_linker_all_I_scope-1_propagg-product_corragg-sum_bbagg-avg"] == 3
    assert s["racs_nodes_T_scope-1_propagg-product_corragg-sum_bbagg-avg"] == 2
    # Walks of three bonds come back to the neighbour.
    assert s["racs_nodes_X_scope-3_propagg-product_corragg-sum_bbagg-avg"] == pytest.approx(1.9 * 3.44) and all(v is None for v in got["t"].values())


def test_charges_and_roles(spark, crystal):
    _, sites, _ = crystal
    made = featurizers.charge_histogram(sites)
    got = {r.struct_id: r.features for r in made.df.collect()}
    assert len(made.labels) == 16 and sum(got["s"]) == pytest.approx(2) and got["t"][6] == pytest.approx(2)
    stats = {r.struct_id: r.features for r in featurizers.charge_stats(sites).df.collect()}
    assert stats["s"][:2] == [1.2, -0.6]
    frags = featurizers.Features(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "frag_id string, features array<double>"), ("x", "y"), "frag_id")
    owners = spark.createDataFrame([("a", "s", "node"), ("b", "s", "node")], "frag_id string, struct_id string, role string")
    made = featurizers.over_roles(frags, owners, names=("mean", "max"))
    assert made.df.first().features == [2.0, 3.0, 3.0, 4.0, None, None, None, None] and len(made.labels) == 8


def test_applied_keeps_failures_apart(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0)], "k int, v double")
    made = featurizers.applied(df, "k", ["v"], lambda v: [1 / v, v], ("inverse", "same"))
    got = {r.k: r for r in made.df.collect()}
    assert got[1].features == [0.5, 2.0] and got[1]._error is None and got[2].features == [None, None] and "ZeroDivision" in got[2]._error
    both = featurizers.concatenated(featurizers.Features(made.df, made.labels, "k"), featurizers.Features(made.df.where("k = 1"), made.labels, "k"))
    assert {r.k: len(r.features) for r in both.df.collect()} == {1: 4, 2: 4}


def test_molecules(spark):
    sites = spark.createDataFrame([("m", 0, "Zn"), ("m", 1, "N"), ("m", 2, "C")], "struct_id string, site_id int, symbol string")
    bonds = graph.both_ways(spark.createDataFrame([("m", 0, 1), ("m", 1, 2)], "struct_id string, i int, j int"), by=["struct_id"])
    left, held = molecules.without_metals(sites, bonds, spark.createDataFrame([("Zn",)], "symbol string"))
    assert left.count() == 2 and held.count() == 2
    charges = molecules.formal_charges(sites, bonds, spark.createDataFrame([("Zn", 2)], "symbol string, charge int"), spark.createDataFrame([("N", 3), ("C", 4)], "symbol string, valence int"))
    assert {r.site_id: r.charge for r in charges.collect()} == {0: 2, 1: -1, 2: -3}
    texts = spark.createDataFrame([("m", "OC(=O)CC(=O)O")], "k string, s string")
    assert molecules.pattern_counts(texts, "k", "s", (r"C\(=O\)O", r"OC\(=O\)")).first().n == 2
    energies = spark.createDataFrame([("m", e) for e in (1.0, 5.0, 20.9, 21.0, 40.0)], "k string, e double")
    assert molecules.conformers_within(energies, "k", "e").first().n == 2
    q = molecules.order_parameters([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], [1] * 6)
    assert q[0] == 6 and q[2] == pytest.approx(1) and q[3] == pytest.approx(0, abs=1e-6) and q[4] == pytest.approx(0.7637626158)
    frags = spark.createDataFrame([("m", "linker", "CC"), ("m", "linker", "CC"), ("m", "node", "Zn")], "k string, role string, smiles string")
    one = spark.createDataFrame([("m", 1.234)], "k string, d double")
    assert molecules.described(one, "k", frags, {"d": "The density is"}).first().description == "It has 2 linker CC, 1 node Zn. The density is 1.23."


def test_force_field(spark):
    config = {"a": {"O": ["lennard-jones", 79.0, 3.0], "C": ["lennard-jones", 27.0, 2.8]}, "b": {"O": ["lennard-jones", 79.0, 3.0]}}
    force_field.check_same(config, ["a", "b"])
    with pytest.raises(ValueError):
        force_field.check_same(config | {"b": {"O": ["lennard-jones", 1.0, 3.0]}}, ["a", "b"])
    atoms = force_field.atom_table(spark, config)
    got = {(r.atom_1, r.atom_2): (r.epsilon, r.sigma) for r in force_field.mixed(atoms).collect()}
    assert set(got) == {("C", "C"), ("C", "O"), ("O", "O")} and got["C", "O"] == pytest.approx(((79 * 27) ** 0.5, 2.9))
    lines = [r.value for r in force_field.mixing_lines(atoms).collect()]
    assert lines[5] == "2" and lines[7].startswith("C lennard-jones 27.000") and lines[-1] == "Lorentz-Berthelot"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")])], "i int, v double, a array<double>").withColumn("s", F.struct("v"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"i":1,"v":null,"a":[1.0,null],"s":{"v":null}}'
    sinks.write_csv(spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), str(tmp_path / "c"), ["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
