"""Queries over readers, featurizers, molecules, getters and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import scalars
from latticework.operators import featurizers, graph, histogram, molecules, pairs, relational, topology
from latticework.plans import bench, metrics, splits
from latticework.plans.queries_data import DIAGRAM, VECTORS, _diagrams, _edges, rounded, t
from latticework.plans.queries_models import GROUP_BINS, LABEL, orders
from latticework.shared import dealt, tasks_for
from latticework.sources import datasets, force_field, text_tables

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


BIN = "CAST(least(floor(({x} - ({low})) / {width}), {n} - 1) AS BIGINT)"


@query(f"""WITH e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS s, event_type AS k, -value / 5 AS x FROM events), c AS (SELECT s, k, {BIN.format(x='x', low=-40, width=1.0, n=40)} AS b, count(*) AS n FROM e WHERE x >= -40 AND x <= 0 GROUP BY 1, 2, 3),
z AS (SELECT s, k, sum(n) AS z FROM c GROUP BY 1, 2), g AS (SELECT s, k, i, b FROM (SELECT DISTINCT s FROM e), (SELECT unnest(['click', 'error']) AS k, unnest([0, 1]) AS i), (SELECT unnest(range(0, 40)) AS b))
SELECT g.s AS struct_id, 'energygrid_' || g.k || '_' || (g.b - 40) AS feature, round(coalesce(c.n / z.z, 0), 8) AS value FROM g LEFT JOIN c ON c.s = g.s AND c.k = g.k AND c.b = g.b LEFT JOIN z ON z.s = g.s AND z.k = g.k""")
def energy_histogram(spark, sf):
    grids = t(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("struct_id"), F.col("event_type").alias("site"), (-F.col("value") / 5).alias("energy"))
    return rounded(featurizers.energy_histogram(grids, kinds=("click", "error")).long(), 8, "value")


SITES = "s AS (SELECT l_orderkey % 50 AS k, l_discount * 80 - 4 AS c, l_quantity / 4 AS d FROM lineitem)"


def _sites(spark, sf):
    return t(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("struct_id"), (F.col("l_discount") * 80 - 4).alias("charge"), (F.col("l_quantity") / 4).alias("distance"))


@query(f"""WITH {SITES}, c AS (SELECT k, {BIN.format(x='c', low=-4, width=0.5, n=16)} AS b, count(*) AS n FROM s WHERE c >= -4 AND c <= 4 GROUP BY 1, 2), z AS (SELECT k, sum(n) AS z FROM c GROUP BY 1), g AS (SELECT k, b FROM (SELECT DISTINCT k FROM s), (SELECT unnest(range(0, 16)) AS b))
SELECT g.k AS struct_id, CAST(g.b AS INTEGER) AS bin, round(coalesce(c.n / (z.z * 0.5), 0), 8) AS value FROM g LEFT JOIN c ON c.k = g.k AND c.b = g.b LEFT JOIN z ON z.k = g.k""")
def charge_histogram(spark, sf):
    made = featurizers.charge_histogram(_sites(spark, sf))
    return made.df.select("struct_id", F.posexplode("features").alias("bin", "value")).select("struct_id", "bin", F.round("value", 8).alias("value"))


@query(f"WITH {SITES} SELECT k AS struct_id, round(max(c), 6) AS charge_max, round(min(c), 6) AS charge_min, round(stddev_pop(c), 6) AS charge_std FROM s GROUP BY 1")
def charge_stats(spark, sf):
    return rounded(featurizers.charge_stats(_sites(spark, sf)).wide(), 6, "charge_max", "charge_min", "charge_std")


@query(f"""WITH {SITES} SELECT k AS struct_id, round(avg(d), 6) AS pairwise_distance_stats_mean, round(stddev_pop(d), 6) AS pairwise_distance_stats_std, round(max(d), 6) AS pairwise_distance_stats_max, round(min(d), 6) AS pairwise_distance_stats_min FROM s GROUP BY 1""")
def distance_stats(spark, sf):
    out = featurizers.distance_stats(_sites(spark, sf)).wide()
    return rounded(out, 6, *out.columns[1:])


@query(f"""WITH {SITES}, c AS (SELECT k, {BIN.format(x='d', low=0, width=0.5, n=30)} AS b, count(*) AS n FROM s WHERE d <= 15 GROUP BY 1, 2), z AS (SELECT k, sum(n) AS z FROM c GROUP BY 1), g AS (SELECT k, b FROM (SELECT DISTINCT k FROM s), (SELECT unnest(range(0, 30)) AS b))
SELECT g.k AS struct_id, CAST(g.b AS INTEGER) AS bin, round(coalesce(c.n / (z.z * 0.5), 0), 8) AS value FROM g LEFT JOIN c ON c.k = g.k AND c.b = g.b LEFT JOIN z ON z.k = g.k""")
def distance_histogram(spark, sf):
    made = featurizers.distance_histogram(_sites(spark, sf))
    return made.df.select("struct_id", F.posexplode("features").alias("bin", "value")).select("struct_id", "bin", F.round("value", 8).alias("value"))


@query(f"""WITH {DIAGRAM}, e AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'C' ELSE 'all' END AS kind, dim, birth, death, death - birth AS persistence FROM d WHERE dim > 0), l AS (SELECT id, kind, dim, 'birth' AS q, birth AS v FROM e UNION ALL SELECT id, kind, dim, 'death', death FROM e UNION ALL SELECT id, kind, dim, 'persistence', persistence FROM e),
a AS (SELECT id, kind, dim, q, min(v) AS mn, max(v) AS mx FROM l GROUP BY 1, 2, 3, 4), x AS (SELECT id, 'phstats_' || kind || '_dim' || dim || '_' || q || '_min' AS f, mn AS v FROM a UNION ALL SELECT id, 'phstats_' || kind || '_dim' || dim || '_' || q || '_max', mx FROM a)
SELECT id AS struct_id, f AS feature, round(v, 6) AS value FROM x WHERE v <> 0""")
def diagram_features(spark, sf):
    own = _diagrams(spark, sf).withColumnRenamed("id", "struct_id").withColumn("atom_type", F.when(F.col("struct_id") % 2 == 0, "C").otherwise("all"))
    return rounded(featurizers.diagram_features(own, ("C", "all"), names=("min", "max")).long().where("value <> 0"), 6, "value")


GRID5 = "p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def _points(spark, sf):
    e = F.col("embedding")
    return t(spark, sf, "embeddings").select("label", "vec_id", *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")])


@query(f"""WITH {GRID5}, g AS (SELECT label, a.i AS vx, b.i AS vy, c.i AS vz FROM (SELECT DISTINCT label FROM p), (SELECT unnest(range(0, 4)) AS i) a, (SELECT unnest(range(0, 4)) AS i) b, (SELECT unnest(range(0, 4)) AS i) c)
SELECT g.label, g.vx, g.vy, g.vz, round(sqrt(min(power(-0.4 + (vx + 0.5) * 0.2 - x, 2) + power(-0.4 + (vy + 0.5) * 0.2 - y, 2) + power(-0.4 + (vz + 0.5) * 0.2 - z, 2))), 6) AS distance FROM g JOIN p ON p.label = g.label GROUP BY 1, 2, 3, 4""")
def voxel_distances(spark, sf):
    return rounded(histogram.voxel_distances(_points(spark, sf), ["label"], ("x", "y", "z"), ((-0.4, 0.4),) * 3, 4), 6, "distance")


@query(f"""WITH {GRID5}, v AS (SELECT DISTINCT label, CAST(greatest(0, least(7, floor((x + 0.4) / 0.1))) AS BIGINT) AS vx, CAST(greatest(0, least(7, floor((y + 0.4) / 0.1))) AS BIGINT) AS vy, CAST(greatest(0, least(7, floor((z + 0.4) / 0.1))) AS BIGINT) AS vz FROM p)
SELECT a.label, count(*) AS n FROM v a JOIN v b ON a.label = b.label AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1 AND (a.vx <> b.vx OR a.vy <> b.vy OR a.vz <> b.vz) GROUP BY 1""")
def voxel_neighbours(spark, sf):
    own = _points(spark, sf).select("label", *[histogram.voxel_of(F.col(c), -0.4, 0.4, 8).cast("long").alias(f"v{c}") for c in "xyz"]).distinct()
    return histogram.voxel_neighbours(own, ["label"]).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT vec_id % 40 AS s, vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), r AS (SELECT unnest(range(-3, 4)) AS n),
m AS (SELECT a.s, a.i, sqrt(power(b.x + u.n * 1.0 + v.n * 0.2 - a.x, 2) + power(b.y + v.n * 1.5 - a.y, 2) + power(b.z + w.n * 2.0 - a.z, 2)) AS d FROM p a JOIN p b ON a.s = b.s, r u, r v, r w WHERE NOT (a.i = b.i AND u.n = 0 AND v.n = 0 AND w.n = 0))
SELECT s AS struct_id, i AS site_id, count(*) AS n, round(sum(d), 4) AS total FROM m WHERE d <= 1.2 GROUP BY 1, 2""")
def radius_neighbours(spark, sf):
    sites = _points(spark, sf).select((F.col("vec_id") % 40).alias("struct_id"), F.col("vec_id").alias("site_id"), "x", "y", "z")
    cell = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ((1.0, 0.0, 0.0), (0.2, 1.5, 0.0), (0.0, 0.0, 2.0))])
    structures = sites.select("struct_id").distinct().withColumn("lattice", cell)
    return rounded(pairs.radius_totals(structures, sites, 1.2), 4, "total")


def _report(labels, *columns):
    return F.concat_ws("   ", *[x for label, c in zip(labels, columns) for x in (F.lit(label + ":"), F.col(c).cast("string"))])


@query("SELECT p_partkey, p_retailprice AS unitcell_volume, CAST(p_size AS DOUBLE) AS density, p_retailprice AS asa_a2, CAST(p_size AS DOUBLE) AS asa_m2cm3, CAST(NULL AS DOUBLE) AS nasa_m2g FROM part")
def surface_reports(spark, sf):
    text = _report(("Unitcell_volume", "Density", "ASA_A^2", "ASA_m^2/cm^3"), "p_retailprice", "p_size", "p_retailprice", "p_size")
    out = text_tables.parse_surface(t(spark, sf, "part").select("p_partkey", F.concat(F.lit("@ x.sa "), text).alias("text")))
    return out.select("p_partkey", "unitcell_volume", "density", "asa_a2", "asa_m2cm3", "nasa_m2g")


@query("SELECT p_partkey, p_retailprice AS unitcell_volume, CAST(p_size AS DOUBLE) AS av_volume_fraction, p_retailprice AS nav_a3, CAST(NULL AS DOUBLE) AS av_cm3g FROM part")
def volume_reports(spark, sf):
    text = _report(("Unitcell_volume", "AV_Volume_fraction", "NAV_A^3"), "p_retailprice", "p_size", "p_retailprice")
    return text_tables.parse_volume(t(spark, sf, "part").select("p_partkey", text.alias("text"))).select("p_partkey", "unitcell_volume", "av_volume_fraction", "nav_a3", "av_cm3g")


@query("SELECT p_partkey, p_retailprice AS lis, CAST(p_size AS DOUBLE) AS lifs, p_retailprice AS lifsp FROM part")
def pore_diameters(spark, sf):
    text = F.concat_ws("  ", F.lit("x.res"), "p_retailprice", "p_size", "p_retailprice")
    return text_tables.parse_pores(t(spark, sf, "part").select("p_partkey", text.alias("text"))).drop("text")


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS bin, o_totalprice AS value FROM orders")
def ray_histogram_lines(spark, sf):
    lines = t(spark, sf, "orders").groupBy("o_custkey").agg(F.concat(F.lit("head\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x.getField("o_totalprice").cast("string")), "\n")).alias("text"))
    return text_tables.parse_histogram_lines(lines, "o_custkey")


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax, l_discount) - 1 AS INTEGER) AS bin, l_quantity AS d, CAST(l_linenumber AS DOUBLE) AS count, l_tax AS cumulative, l_discount AS derivative FROM lineitem")
def pore_size_table(spark, sf):
    row = F.concat_ws(" ", "l_quantity", "l_linenumber", "l_tax", "l_discount")
    text = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.concat(F.array_repeat(F.lit("head of words"), 11), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax", "l_discount", row.alias("r")))), lambda x: x.getField("r"))), "\n").alias("text"))
    return text_tables.parse_pore_distribution(text, "l_orderkey")


@query("SELECT event_id, value AS henry_coefficient, round(user_id * 8.314464919 / 1000, 8) AS enthalpy_kj_mol FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, value, NULL FROM events WHERE event_id % 3 = 0")
def widom_logs(spark, sf):
    more = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("\nAverage Enthalpy of adsorption: "), F.col("user_id"), F.lit(" [K]"))).otherwise("")
    text = F.concat(F.lit("Simulation\n=====\nAverage Henry coefficient: "), F.col("value"), F.lit(" [mol/kg/Pa]"), more)
    lines = text_tables.log_sections(t(spark, sf, "events").select("event_id", text.alias("text")), "event_id", {"averages": "^====="})
    return rounded(text_tables.widom(text_tables.log_values(lines, "event_id"), "event_id"), 8, "enthalpy_kj_mol")


@query("""SELECT c_custkey, replace(replace('R' || substr(c_name, 1, 2) || CASE WHEN c_custkey % 2 = 0 THEN substr(c_mktsegment, 1, 2) ELSE substr(d, 3, 2) END || substr(d, 5, 2) || CASE WHEN c_custkey % 3 = 0 THEN 'a-' ELSE substr(d, 7, 2) END || '20240101000000', '/', '-'), ' ', '_') AS report_id
FROM (SELECT *, translate(to_base64(unhex(sha1(c_name || c_mktsegment))), '+/', '-_') AS d FROM customer)""")
def report_id_parts(spark, sf):
    c = F.col
    own = t(spark, sf, "customer").withColumn("features", F.when(c("c_custkey") % 2 == 0, c("c_mktsegment"))).withColumn("reference", F.when(c("c_custkey") % 3 == 0, "a/b"))
    made = bench.report_id_of_parts(c("c_name"), c("features"), F.lit(""), c("reference"), F.concat("c_name", "c_mktsegment"), F.lit("20240101000000"))
    return own.select("c_custkey", made.alias("report_id"))


@query("""WITH c AS (SELECT event_type, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(0, 20)) AS bin) LEFT JOIN (SELECT event_type AS e, CAST(least(floor(value / 10), 19) AS BIGINT) AS b, count(*) AS n FROM events WHERE value >= 0 AND value <= 200 GROUP BY 1, 2) ON e = event_type AND b = bin),
h AS (SELECT event_type, stddev_samp(n) * 0.5 AS h, count(*) AS m FROM c GROUP BY 1), g AS (SELECT unnest(range(0, 6)) AS point)
SELECT event_type, CAST(point AS INTEGER) AS point, round(sum(exp(-power((point * 4.0 - n) / h, 2) / 2) / (h * m * sqrt(2 * pi()))), 8) AS density FROM c JOIN h USING (event_type), g GROUP BY 1, 2""")
def smeared_counts(spark, sf):
    counts = histogram.histogram(t(spark, sf, "events"), ["event_type"], "value", 0.0, 200.0, 10.0)
    return rounded(histogram.smear(counts, ["event_type"], "n", 0.0, 20.0, 6, 0.5), 8, "density")


@query("SELECT o_custkey, CAST(list_sort(flatten(list([o_orderkey, o_orderkey + 1]))) AS VARCHAR) AS x FROM orders GROUP BY 1")
def flat_lists(spark, sf):
    nested = t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.array(F.array("o_orderkey"), F.array(F.col("o_orderkey") + 1))).alias("x"))
    own = relational.flat(nested, "x").select("o_custkey", F.array_sort("x").alias("x"))
    return own.select("o_custkey", F.concat(F.lit("["), F.array_join("x", ", "), F.lit("]")).alias("x"))


@query('SELECT n_nationkey AS "nation.key", n_name AS "nation.label", n_regionkey AS "nation.regionkey" FROM nation')
def renamed_columns(spark, sf):
    return relational.renamed(t(spark, sf, "nation"), {"n_nation": "n_", "n_name": "n_label", "n_": "nation."}).select("`nation.key`", "`nation.label`", "`nation.regionkey`")


@query(f"WITH {DIAGRAM}, r AS (SELECT id, dim, birth, death, row_number() OVER (PARTITION BY id, dim ORDER BY round(death - birth, 9) DESC, birth) AS \"order\" FROM (SELECT id, dim, birth, birth + round(death - birth, 9) AS death FROM d GROUP BY ALL)) SELECT id, dim, CAST(\"order\" AS INTEGER) AS \"order\", round(death - birth, 6) AS persistence FROM r WHERE \"order\" <= 5")
def interval_order(spark, sf):
    own = _diagrams(spark, sf).withColumn("death", F.col("birth") + F.round(F.col("death") - F.col("birth"), 9)).distinct()
    out = topology.by_persistence(own, ["id", "dim"], "birth").where(F.col("order") <= 5)
    return out.select("id", "dim", "order", F.round("persistence", 6).alias("persistence"))


@query("""WITH c AS (SELECT 'n' || n_nationkey AS node, n_name AS name FROM nation UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier) SELECT m.node, m.name, g.name AS nation FROM
(SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS of FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) l JOIN c g ON l.of = g.node AND g.name LIKE '%1%' JOIN c m ON m.node = l.node""")
def provenance_members(spark, sf):
    name = lambda letter, key: F.concat(F.lit(letter), key).alias("node")
    n, c, s = (t(spark, sf, x) for x in ("nation", "customer", "supplier"))
    nodes = n.select(name("n", "n_nationkey"), F.col("n_name").alias("name")).union(c.select(name("c", "c_custkey"), "c_name")).union(s.select(name("s", "s_suppkey"), "s_name"))
    links = c.select(name("c", "c_custkey"), F.concat(F.lit("n"), "c_nationkey").alias("of")).union(s.select(name("s", "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    return relational.members_of(links, nodes, "%1%", "nation").select("node", "name", "nation")


@query("SELECT c_custkey * 3 AS pos, o_totalprice, o_orderstatus FROM customer JOIN orders ON o_orderkey = c_custkey WHERE c_nationkey < 5")
def labels_of_subset(spark, sf):
    rows = t(spark, sf, "customer").where("c_nationkey < 5").select((F.col("c_custkey") * 3).alias("pos"), F.col("c_custkey").alias("row_id"))
    return relational.take_columns(t(spark, sf, "orders"), "o_orderkey", rows, ["o_totalprice", "o_orderstatus"])


@query("SELECT k.l_orderkey, l.l_returnflag FROM (SELECT DISTINCT l_orderkey FROM lineitem) k LEFT JOIN (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('R')) l ON l.l_orderkey = k.l_orderkey")
def element_filter(spark, sf):
    return relational.with_elements(t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["R"])


@query("SELECT o_custkey, count(*) FILTER (WHERE o_totalprice - lo < 20000) - 1 AS n FROM orders JOIN (SELECT o_custkey, min(o_totalprice) AS lo FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1")
def conformer_counts(spark, sf):
    return molecules.conformers_within(t(spark, sf, "orders"), "o_custkey", "o_totalprice", 20000.0)


BONDS = "b AS (SELECT DISTINCT l_orderkey AS s, l_linenumber AS i, l_partkey % 7 AS j FROM lineitem), z AS (SELECT DISTINCT l_orderkey AS s, l_linenumber AS i, l_returnflag AS y FROM lineitem)"


def _molecule(spark, sf):
    own = t(spark, sf, "lineitem")
    bonds = own.select(F.col("l_orderkey").alias("struct_id"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 7).alias("j")).distinct()
    sites = own.select(F.col("l_orderkey").alias("struct_id"), F.col("l_linenumber").alias("site_id"), F.col("l_returnflag").alias("symbol")).distinct()
    return sites, bonds


@query(f"WITH {BONDS}, d AS (SELECT s, i, count(*) AS n FROM b GROUP BY 1, 2) SELECT z.s AS struct_id, z.i AS site_id, CAST(CASE y WHEN 'R' THEN 2 WHEN 'A' THEN coalesce(n, 0) - 4 ELSE 0 END AS INTEGER) AS charge FROM z LEFT JOIN d ON d.s = z.s AND d.i = z.i")
def formal_charges(spark, sf):
    sites, bonds = _molecule(spark, sf)
    return molecules.formal_charges(sites, bonds, spark.createDataFrame([("R", 2)], "symbol string, charge int"), spark.createDataFrame([("A", 4)], "symbol string, valence int"))


@query(f"WITH {BONDS}, m AS (SELECT s, i FROM z WHERE y = 'R') SELECT b.s AS struct_id, b.i, b.j FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.s = b.s AND (m.i = b.i OR m.i = b.j))")
def bonds_without_metals(spark, sf):
    sites, bonds = _molecule(spark, sf)
    return molecules.without_metals(sites, bonds, spark.createDataFrame([("R",)], "symbol string"))[1].select("struct_id", "i", "j")


@query(f"WITH v AS ({VECTORS}) SELECT a.label, round(max(list_distance(a.e, b.e)), 6) AS side FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def box_sides(spark, sf):
    own = t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))
    return rounded(pairs.box_side(own, "label", "vec_id", "e"), 6, "side")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 8.314464919 / 1000, 8) AS kj, split_part('a_' || l_returnflag || '_c', '_', 2) AS part, round(4.0 / 3 * pi() * (power(l_quantity + 1, 3) - power(l_quantity, 3)), 4) AS shell, round(l_linenumber * 20.0 / 4, 6) AS birth, round(l_linenumber * 20.0 / 4 + l_linenumber * 10.0 / 9, 6) AS death FROM lineitem")
def units_and_names(spark, sf):
    c = F.col
    at = topology.pixel_place(c("l_linenumber"), c("l_linenumber"), (5, 10), 20.0, 10.0)
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scalars.kelvin_to_kj(c("l_quantity")), 8).alias("kj"), scalars.name_part(F.concat(F.lit("a_"), "l_returnflag", F.lit("_c")), 1).alias("part"),
        F.round(scalars.shell_volume(c("l_quantity"), c("l_quantity") + 1), 4).alias("shell"), F.round(at["birth"], 6).alias("birth"), F.round(at["death"], 6).alias("death"),
    )


@query("SELECT p_partkey, round(p_size * 1e-6, 12) AS abundance, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN p_size + 0.5 ELSE CAST(p_size AS DOUBLE) END AS price FROM part")
def element_table_cleaning(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    abundance = F.concat(F.when(kind == 0, "~ ").when(kind == 1, "≤ ").otherwise(""), size, F.when(kind == 2, " [i]").otherwise(""))
    price = F.when(kind == 0, "Not traded.").when(kind == 1, "Negative price.").when(kind == 2, F.concat(size, F.lit("–"), (F.col("p_size") + 1).cast("string"))).otherwise(size)
    return t(spark, sf, "part").select("p_partkey", F.round(scalars.clean_abundance(abundance), 12).alias("abundance"), scalars.clean_price(price).alias("price"))


@query(f"""WITH {GROUP_BINS}, s AS (SELECT o_custkey, {LABEL.format(n='n')} AS split FROM r), x AS (SELECT o_orderkey, split FROM orders JOIN s USING (o_custkey)),
y AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k, count(*) OVER (PARTITION BY split) AS m FROM x) SELECT o_orderkey, split FROM y WHERE k <= floor(m * 0.6 + 1e-9)""")
def split_dispatch(spark, sf):
    return splits.with_split(orders(spark, sf), "o_orderkey", 0.7, 0.1, 42, group="o_custkey", stratum="o_totalprice", sample_frac=0.6).select("o_orderkey", "split")


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('3:' || o_orderkey), o_orderkey) - 1) % 4 AS INTEGER) AS fold FROM orders")
def fold_dispatch(spark, sf):
    return splits.with_fold(orders(spark, sf), "o_orderkey", 4, 3, stratum="o_orderstatus", categorical=True).select("o_orderkey", "fold")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.7) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split, CAST(CASE WHEN k < (n % 3) * (n // 3 + 1) THEN k // (n // 3 + 1) ELSE n % 3 + (k - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS fold FROM r""")
def order_splits(spark, sf):
    from latticework.shared import ranked

    own = ranked(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", name="order")
    return splits.fold_by_order(splits.split_by_order(own, "order", 0.7, 0.1), "order", 3).select("o_orderkey", "split", "fold")


@query("SELECT CAST(row_number() OVER (ORDER BY year(o_orderdate)) - 1 AS INTEGER) AS pos, round(avg(o_totalprice), 4) AS mae, round(max(o_totalprice), 4) AS largest FROM orders GROUP BY year(o_orderdate)")
def metrics_of_folds(spark, sf):
    folds = orders(spark, sf).groupBy("year").agg(F.avg("o_totalprice").alias("mae"), F.max("o_totalprice").alias("largest"))
    lists = metrics.concatenated(folds, ("mae", "largest"), "year")
    return rounded(lists.select(F.posexplode(F.arrays_zip("mae", "largest")).alias("pos", "m")).select("pos", "m.mae", "m.largest"), 4, "mae", "largest")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS a, 100 + l_partkey % 5 AS b FROM lineitem), x AS (SELECT g, a AS i, b AS j FROM e UNION SELECT g, b, a FROM e), l AS (SELECT g, i FROM x GROUP BY 1, 2 HAVING count(*) = 1)
SELECT x.g, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.g = x.g AND (l.i = x.i OR l.i = x.j)) GROUP BY 1""")
def scaffold_edges(spark, sf):
    own = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("i"), (100 + F.col("l_partkey") % 5).alias("j"))
    tasks = tasks_for(spark, 2 * own.count())
    found = graph.scaffold(graph.both_ways(own, by=["g"], tasks=tasks), ["g"], tasks)
    return dealt(found, tasks, "g").groupBy("g").agg(F.count("*").alias("n"))


@query(f"""WITH v AS ({VECTORS}), p AS (SELECT a.label, a.e AS x, b.e AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id < 200 AND b.vec_id < 200),
m AS (SELECT label, list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) AS l1, list_max(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) AS li, list_sum(list_transform(range(1, 65), lambda i: abs(x[i] + y[i]))) AS s,
list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]) / (abs(x[i]) + abs(y[i])))) AS ca, list_cosine_distance(x, y) AS co FROM p)
SELECT label, round(avg(l1), 5) AS cityblock, round(avg(li), 5) AS chebyshev, round(avg(l1 / s), 5) AS braycurtis, round(avg(ca), 5) AS canberra, round(avg(co), 5) AS cosine FROM m GROUP BY 1""")
def distance_metrics(spark, sf):
    own = t(spark, sf, "embeddings").where("vec_id < 200").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    met = pairs.pairs_within(own, "label", "vec_id", "e")
    return met.groupBy("label").agg(*[F.round(F.avg(pairs.distance(F.col("e_a"), F.col("e_b"), m)), 5).alias(m) for m in ("cityblock", "chebyshev", "braycurtis", "canberra", "cosine")])


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '(?:ing)|(?:ung)|(?:ción)')) AS INTEGER) AS n FROM documents")
def pattern_matches(spark, sf):
    return molecules.pattern_counts(t(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text", ("ing", "ung", "ción")).select("doc_id", F.col("n").cast("int").alias("n"))


@query("""WITH f AS (SELECT p_type AS atom, round(avg(p_size), 3) AS epsilon, round(avg(p_retailprice), 3) AS sigma FROM part GROUP BY 1) SELECT a.atom AS atom_1, b.atom AS atom_2, round(sqrt(a.epsilon * b.epsilon), 6) AS epsilon, round(sqrt(a.sigma * b.sigma), 6) AS sigma FROM f a JOIN f b ON a.atom <= b.atom""")
def mixed_atoms(spark, sf):
    atoms = t(spark, sf, "part").groupBy(F.col("p_type").alias("atom")).agg(F.round(F.avg("p_size"), 3).alias("epsilon"), F.round(F.avg("p_retailprice"), 3).alias("sigma"))
    return rounded(force_field.mixed(atoms, "Jorgensen"), 6, "epsilon", "sigma")


@query("""SELECT p_partkey, CAST(ceil(30 / (5.0 + p_size)) AS INTEGER) AS na, CAST(ceil(30 / 7.0) AS INTEGER) AS nb, CAST(ceil(30 / (p_size / 2.0 + 1)) AS INTEGER) AS nc FROM part""")
def cell_replicas(spark, sf):
    size, zero = F.col("p_size").cast("double"), F.lit(0.0)
    cell = F.array(F.array(5 + size, zero, zero), F.array(zero, F.lit(7.0), zero), F.array(zero, zero, size / 2 + 1))
    n = pairs.replicas(cell, 30.0)
    return t(spark, sf, "part").select("p_partkey", *[n[i].alias(c) for i, c in enumerate(("na", "nb", "nc"))])


@query(f"WITH {DIAGRAM}, e AS (SELECT dim, id, power(birth - 50, 2) + power(death - birth - 3, 2) AS d FROM d WHERE birth = round(birth, 2)) SELECT dim, min(round(sqrt(d), 4)) AS d FROM e GROUP BY 1")
def nearest_point_distance(spark, sf):
    own = topology.with_persistence(_diagrams(spark, sf))
    found = pairs.nearest_point(own.withColumn("at", F.struct("birth", "persistence")), 50.0, 3.0, ["dim"], "at")
    gap = lambda c, x: (F.col(f"at.{c}") - x) * (F.col(f"at.{c}") - x)
    return found.select("dim", F.round(F.sqrt(gap("birth", 50.0) + gap("persistence", 3.0)), 4).alias("d"))


@query("SELECT o_orderkey, o_totalprice, '/data/' || o_orderkey || '.cif' AS file FROM orders WHERE o_orderkey % 3 = 0")
def frame_rows_with_files(spark, sf):
    own = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").cast("string").alias("info.name"))
    files = own.where("o_orderkey % 3 = 0").select(F.concat(F.lit("/data/"), "`info.name`", F.lit(".cif")).alias("path"))
    return datasets.from_files(files, own, "info.name").select("o_orderkey", "o_totalprice", "file")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS r, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT l_orderkey, 'It has ' || string_agg(n || ' ' || r || ' ' || s, ', ' ORDER BY r, s) || '.' AS t FROM c GROUP BY 1)
SELECT o_orderkey, f.t || ' The price is ' || printf('%.2f', o_totalprice) || '.' AS description FROM orders JOIN f ON l_orderkey = o_orderkey""")
def described_structures(spark, sf):
    parts = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("smiles"))
    own = t(spark, sf, "orders").join(parts.select("o_orderkey").distinct(), "o_orderkey", "left_semi")
    return molecules.described(own, "o_orderkey", parts, {"o_totalprice": "The price is"})


@query("""WITH v AS (SELECT vec_id % 50 AS s, vec_id AS i, label = 0 AS g, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT unnest([-1.0, 0.0, 1.0]) AS n),
d AS (SELECT a.s, min(sqrt(power((b.e[1] - a.e[1] + p.n) * 4, 2) + power((b.e[2] - a.e[2] + q.n) * 4, 2) + power((b.e[3] - a.e[3] + r.n) * 4, 2))) AS d FROM v a JOIN v b ON a.s = b.s AND a.g AND NOT b.g, n p, n q, n r GROUP BY a.s, a.i, b.i),
w AS (SELECT s, least(floor((d - 0.2) / 0.25), 10) AS bin, d FROM d WHERE d < 3.0 AND d > 0.2) SELECT CAST(s AS VARCHAR) AS struct_id, 'aprdf_X_product_' || CAST(bin AS INTEGER) AS feature, round(sum(6 * exp(-10 * power(d - (0.2 + bin * (2.8 / 10)), 2))), 6) AS value FROM w GROUP BY 1, 2""")
def guest_aprdf(spark, sf):
    e = F.col("embedding")
    roles = t(spark, sf, "embeddings").select((F.col("vec_id") % 50).cast("string").alias("struct_id"), F.when(F.col("label") == 0, "guest").when(F.col("label") != 0, "host").alias("role"), F.when(F.col("label") == 0, "A").otherwise("B").alias("symbol"), *[F.get(e, i).cast("double").alias(n) for i, n in enumerate(("fx", "fy", "fz"))])
    cell = F.array(*[F.array(*[F.lit(4.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    structures = roles.select("struct_id").distinct().withColumn("lattice", cell)
    made = featurizers.guest_aprdf(structures, roles, spark.createDataFrame([("A", 2.0), ("B", 3.0)], "symbol string, X double"), ("X",), ("product",), 3.0, 0.2, 0.25, 10.0)
    return rounded(made.long().where("value <> 0"), 6, "value")


@query("""WITH e AS (SELECT c_custkey AS i, 1000000 + c_nationkey AS j FROM customer UNION SELECT s_suppkey + 2000000, 1000000 + s_nationkey FROM supplier), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e) SELECT i, count(*) AS degree FROM b GROUP BY 1""")
def bond_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf), [])


@query()
def atom_centred_stats(spark, sf):
    """Diagrams of dimension 0 about every site, of what stands within a radius of it, and their statistics by species and over all."""
    from latticework.operators.atom_centred import atom_centred_stats

    sites = _points(spark, sf).where("vec_id < 400").select((F.col("vec_id") % 20).alias("struct_id"), F.col("vec_id").alias("site_id"), F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("symbol"), "x", "y", "z")
    cell = F.array(*[F.array(*[F.lit(1.5 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    structures = sites.select("struct_id").distinct().withColumn("lattice", cell)
    return atom_centred_stats(structures, sites, ("A", "B"), 0.9)
