"""Queries over the relational core, aggregators, pairs, histograms and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.aggregators import COMBINERS, NAMES, aggregate, combine
from latticework.operators import graph, groupwise, histogram, pairs, relational, topology
from latticework.shared import written

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if c in columns else c for c in df.columns])


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, sf):
    return relational.keep_first(t(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("h")), ["h"], ["doc_id"]).select("doc_id", "lang")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_totalprice, o_orderkey) AS m FROM a WHERE n = 1)
SELECT o_orderkey, o_custkey, o_totalprice FROM b WHERE m = 1""")
def dedup_sequential_by_energy(spark, sf):
    own = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("d"))
    return relational.keep_first_in_turn(own, ["o_custkey", "d"], ["o_totalprice", "o_orderkey"]).drop("d")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IS NOT NULL AND l_quantity IS NOT NULL AND l_linenumber IS NOT NULL AND l_shipdate IS NOT NULL AND l_tax IS NOT NULL")
def null_drop_prefix(spark, sf):
    return relational.drop_nulls(relational.project_prefix(t(spark, sf, "lineitem"), "l_"), "l_").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def flavor_filter(spark, sf):
    return relational.where_flavor(t(spark, sf, "documents").withColumn("flavor.en", F.col("lang") == "en"), "en").select("doc_id", "source")


@query("SELECT p.pos AS row_id, o.o_orderkey, o.o_totalprice FROM (SELECT c_custkey AS row_id, c_custkey * 7 AS pos FROM customer WHERE c_nationkey = 3) p JOIN orders o ON o.o_orderkey = p.row_id")
def positional_subset(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderkey", "o_totalprice")
    where = t(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("row_id"), (F.col("c_custkey") * 7).alias("pos"))
    return relational.take_positions(rows, "row_id", where).select("row_id", "o_orderkey", "o_totalprice")


@query("""
WITH m AS (SELECT min(p_size) a, max(p_size) b, min(p_partkey) c, max(p_partkey) d FROM part),
r AS (SELECT 'p_size' AS "column", a AS lo, b AS hi FROM m UNION ALL SELECT 'p_partkey', c, d FROM m)
SELECT "column", CASE WHEN lo >= -128 AND hi < 127 THEN 'tinyint' WHEN lo >= -32768 AND hi < 32767 THEN 'smallint' WHEN lo >= -2147483648 AND hi < 2147483647 THEN 'int' ELSE 'bigint' END AS type FROM r
UNION ALL SELECT 'p_retailprice', 'float'""")
def compress_types(spark, sf):
    return spark.createDataFrame(sorted(relational.narrowed_types(t(spark, sf, "part")).items()), "column string, type string")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def left_semi_files(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def left_anti_resume(spark, sf):
    from latticework.streaming.resume import not_done

    return not_done(t(spark, sf, "documents").select("doc_id", "n_chars"), t(spark, sf, "labels"), "doc_id")


def _agg_sql(x: str, every: str) -> str:
    return f"""SELECT g.l_returnflag, round(sum({x}), 4) AS "sum", round(avg({x}), 6) AS "avg", max({x}) AS "max", min({x}) AS "min", round(stddev_pop({x}), 6) AS "std", max({x}) - min({x}) AS "range",
round(avg({x}), 6) AS "mean", quantile_cont({x}, 0.5) AS "median", round(exp(avg(ln({x}))), 6) AS "geomean", round(count({x}) / sum(1 / {x}), 6) AS "harmean", quantile_cont(abs({x} - m), 0.5) AS "mad",
(quantile_cont({x}, 0.25) + 2 * quantile_cont({x}, 0.5) + quantile_cont({x}, 0.75)) / 4 AS "trimean", max(abs({every})) AS "inf", round(sum(abs({every})), 4) AS "manhattan" """


@query(f"""WITH q AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x FROM lineitem), c AS (SELECT l_returnflag, quantile_cont(x, 0.5) AS m FROM q GROUP BY 1)
{_agg_sql("x", "x")} FROM q g JOIN c USING (l_returnflag) GROUP BY g.l_returnflag""".replace("SELECT g.l_returnflag", "SELECT g.l_returnflag AS l_returnflag"))
def array_aggregators(spark, sf):
    out = aggregate(t(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return rounded(rounded(out, 6, "avg", "std", "mean", "geomean", "harmean"), 4, "sum", "manhattan")


@query(f"""WITH q AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS a, CASE WHEN l_discount > 0.05 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS x FROM lineitem), c AS (SELECT l_returnflag, quantile_cont(x, 0.5) AS m FROM q GROUP BY 1)
{_agg_sql("x", "a")} FROM q g JOIN c USING (l_returnflag) GROUP BY g.l_returnflag""".replace("SELECT g.l_returnflag", "SELECT g.l_returnflag AS l_returnflag"))
def masked_aggregators(spark, sf):
    out = aggregate(t(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", NAMES, F.col("l_discount") > 0.05)
    return rounded(rounded(out, 6, "avg", "std", "mean", "geomean", "harmean"), 4, "sum", "manhattan")


@query("""SELECT l_returnflag, round(avg(l_discount + l_tax), 6) AS c_sum, round(avg((l_discount + l_tax) / 2), 6) AS c_avg, round(avg(greatest(l_discount, l_tax)), 6) AS c_max, round(avg(least(l_discount, l_tax)), 6) AS c_min,
round(avg(l_discount), 6) AS c_first, round(avg(l_tax), 6) AS c_last, round(avg(l_discount * l_tax), 6) AS c_product, round(avg(abs(l_tax - l_discount)), 6) AS c_diff, round(avg(abs(l_tax - l_discount)), 6) AS c_absdiff FROM lineitem GROUP BY 1""")
def pair_combiners(spark, sf):
    own = t(spark, sf, "lineitem")
    return own.groupBy("l_returnflag").agg(*[F.round(F.avg(combine(n, F.col("l_discount"), F.col("l_tax"))), 6).alias(f"c_{n}") for n in COMBINERS])


VECTORS = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
PAIRS = f"v AS ({VECTORS}), p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)"


def _vectors(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))


@query(f"WITH {PAIRS} SELECT label, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(max(d), 6) AS max, round(min(d), 6) AS min FROM p GROUP BY label")
def pair_distance_stats(spark, sf):
    return rounded(pairs.pair_statistics(_vectors(spark, sf), "label", "vec_id", "e"), 6, "mean", "std", "max", "min")


@query(f"""WITH {PAIRS}, g AS (SELECT label, unnest(range(0, 40)) AS bin FROM (SELECT DISTINCT label FROM p)), c AS (SELECT label, CAST(floor(d / 0.05) AS BIGINT) AS bin, count(*) AS n FROM p WHERE d < 2 GROUP BY 1, 2)
SELECT g.label, CAST(g.bin AS BIGINT) AS bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.label = c.label AND g.bin = c.bin""")
def pair_distance_hist(spark, sf):
    return pairs.pair_histogram(_vectors(spark, sf), "label", "vec_id", "e", 0.0, 2.0, 0.05)


CENTRES = [0.8 + 0.1 * i for i in range(8)]


@query(f"""WITH {PAIRS}, c AS (SELECT unnest([{", ".join(repr(c) for c in CENTRES)}]) AS centre, unnest(range(0, 8)) AS bin)
SELECT label, combiner, CAST(bin AS INTEGER) AS bin, round(sum(w * exp(-10 * (d - centre) * (d - centre))), 4) AS weight FROM (
  SELECT label, d, 'avg' AS combiner, (a % 7 + b % 7) / 2.0 AS w FROM p UNION ALL SELECT label, d, 'product', (a % 7) * (b % 7) FROM p UNION ALL SELECT label, d, 'diff', abs(b % 7 - a % 7) FROM p) x, c
WHERE d < 1.6 AND d > 0.2 GROUP BY 1, 2, 3""")
def aprdf_weighted_hist(spark, sf):
    own = _vectors(spark, sf).withColumn("p", F.col("vec_id") % 7)
    return rounded(pairs.weighted_pair_histogram(own, "label", "vec_id", "e", "p", ("avg", "product", "diff"), CENTRES, 10.0, 1.6, 0.2), 4, "weight")


@query(f"""WITH {PAIRS}, w AS (SELECT label, a AS i, d FROM p UNION ALL SELECT label, b, d FROM p), r AS (SELECT label, i, d, row_number() OVER (PARTITION BY label, i ORDER BY d) AS rank FROM w)
SELECT label, CAST(rank AS INTEGER) AS rank, round(avg(d), 6) AS mean_distance FROM r WHERE rank <= 10 GROUP BY 1, 2""")
def knn_mean_distance(spark, sf):
    return rounded(pairs.average_minimum_distances(_vectors(spark, sf), "label", "vec_id", "e", 10), 6, "mean_distance")


@query(f"""WITH v AS ({VECTORS}), g AS (SELECT vec_id % 5 AS s, * FROM v) SELECT a.s AS struct, count(*) AS n, round(sum(exp(-list_distance(a.e, b.e))), 4) AS weight
FROM g a JOIN g b ON a.s = b.s WHERE a.label = 0 AND b.label <> 0 AND list_distance(a.e, b.e) < 1.6 GROUP BY 1""")
def guest_host_cross(spark, sf):
    own = _vectors(spark, sf).withColumn("struct", F.col("vec_id") % 5)
    return rounded(pairs.cross_contacts(own, "struct", "vec_id", "e", (F.col("label") == 0, F.col("label") != 0), 1.6), 4, "weight")


@query("""WITH p AS (SELECT p_type AS symbol, avg(p_size) AS mass, avg(p_retailprice) AS price FROM part GROUP BY 1), s AS (SELECT DISTINCT l_orderkey, p_type AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, round(sum(mass * price) / sum(mass), 4) AS gravimetric FROM s JOIN p USING (symbol) GROUP BY 1""")
def element_price_lookup(spark, sf):
    part = t(spark, sf, "part")
    elements = part.groupBy(F.col("p_type").alias("symbol")).agg(F.avg("p_size").alias("mass"), F.avg("p_retailprice").alias("price"))
    sites = t(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_type").alias("symbol"))
    return rounded(groupwise.price_bound(sites, elements, "l_orderkey"), 4, "gravimetric")


EDGES = "e0 AS (SELECT c_custkey AS i, 1000000 + c_nationkey AS j FROM customer UNION SELECT s_suppkey + 2000000, 1000000 + s_nationkey FROM supplier), e AS (SELECT i, j FROM e0 UNION SELECT j, i FROM e0)"


def _edges(spark, sf, where: str = "true"):
    c = t(spark, sf, "customer").where(where).select(F.col("c_custkey").alias("i"), (F.lit(1000000) + F.col("c_nationkey")).cast("long").alias("j"))
    s = t(spark, sf, "supplier").select((F.col("s_suppkey") + 2000000).alias("i"), (F.lit(1000000) + F.col("s_nationkey")).cast("long").alias("j"))
    return graph.both_ways(c.union(s))


@query(f"""WITH {EDGES}, s AS (SELECT DISTINCT i AS s FROM e WHERE i >= 2000000), w1 AS (SELECT DISTINCT s, j FROM s JOIN e ON s = i), w2 AS (SELECT DISTINCT s, e.j FROM w1 JOIN e ON w1.j = e.i), w3 AS (SELECT DISTINCT s, e.j FROM w2 JOIN e ON w2.j = e.i)
SELECT 1 AS scope, s AS start, count(*) AS n FROM w1 WHERE s <> j GROUP BY s UNION ALL SELECT 2, s, count(*) FROM w2 WHERE s <> j GROUP BY s UNION ALL SELECT 3, s, count(*) FROM w3 WHERE s <> j GROUP BY s""")
def graph_walk_neighbours(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    start = edges.where("i >= 2000000").select(F.col("i").alias("start")).distinct()
    return graph.walk_counts(edges, 3, start)


@query(f"""WITH {EDGES}, w AS (SELECT DISTINCT a.i AS s, b.j FROM e a JOIN e b ON a.j = b.i WHERE a.i >= 2000000 AND b.j < 1000000),
x AS (SELECT s % 3 AS block, (s % 11) * (j % 11) AS p, abs(j % 11 - s % 11) AS d FROM w),
b AS (SELECT block, 'product' AS combiner, CAST(sum(p) AS DOUBLE) AS s, avg(p) AS a FROM x GROUP BY 1 UNION ALL SELECT block, 'diff', CAST(sum(d) AS DOUBLE), avg(d) FROM x GROUP BY 1)
SELECT combiner, pair_agg, block_agg, round(v, 4) AS value FROM (SELECT combiner, 'sum' AS pair_agg, 'avg' AS block_agg, avg(s) AS v FROM b GROUP BY 1 UNION ALL SELECT combiner, 'sum', 'sum', sum(s) FROM b GROUP BY 1
UNION ALL SELECT combiner, 'avg', 'avg', avg(a) FROM b GROUP BY 1 UNION ALL SELECT combiner, 'avg', 'sum', sum(a) FROM b GROUP BY 1)""")
def rac_nested_agg(spark, sf):
    edges = written(_edges(spark, sf), "edges")
    value = (F.col("i") % 11).alias("value")
    start = edges.where("i >= 2000000").select((F.col("i") % 3).alias("block"), F.col("i").alias("start"), value).distinct()
    ends = edges.where("i < 1000000").select(F.col("i").alias("node"), value).distinct()
    return rounded(graph.autocorrelations(graph.walk_values(edges, 2, start, ends), ("product", "diff"), ("sum", "avg"), ("avg", "sum")), 4, "value")


@query(f"""WITH {EDGES}, l0 AS (SELECT DISTINCT i AS node, CASE WHEN i < 1000000 THEN 'c' WHEN i < 2000000 THEN 'n' ELSE 's' END AS label FROM e),
l1 AS (SELECT a.node, md5(any_value(a.label) || '|' || string_agg(b.label, ',' ORDER BY b.label)) AS label FROM l0 a JOIN e ON e.i = a.node JOIN l0 b ON b.node = e.j GROUP BY a.node),
l2 AS (SELECT a.node, md5(any_value(a.label) || '|' || string_agg(b.label, ',' ORDER BY b.label)) AS label FROM l1 a JOIN e ON e.i = a.node JOIN l1 b ON b.node = e.j GROUP BY a.node)
SELECT label, count(*) AS n FROM l2 GROUP BY label""")
def wl_hash_groups(spark, sf):
    edges = _edges(spark, sf)
    labels = edges.select(F.col("i").alias("node")).distinct().withColumn("label", F.when(F.col("node") < 1000000, "c").when(F.col("node") < 2000000, "n").otherwise("s"))
    return graph.refine(labels, edges, 2).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey % 500 AS i, 1000 + l_partkey % 700 AS j FROM lineitem WHERE l_suppkey % 10 = 3), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
r AS (SELECT DISTINCT i AS node FROM b) SELECT node, c AS component FROM (
WITH RECURSIVE x(node, c) AS (SELECT node, node FROM r UNION SELECT b.j, x.c FROM x JOIN b ON b.i = x.node WHERE x.c < b.j) SELECT node, min(c) AS c FROM x GROUP BY node)""")
def connected_components(spark, sf):
    edges = t(spark, sf, "lineitem").where("l_suppkey % 10 = 3").select((F.col("l_orderkey") % 500).alias("i"), (1000 + F.col("l_partkey") % 700).alias("j")).distinct()
    return graph.components(edges)


@query()
def connected_components_all(spark, sf):
    """All of lineitem: orders and parts, parts as negative ids. Recursive SQL is too slow for it; a test follows the links instead."""
    return graph.components(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), (-1 - F.col("l_partkey")).alias("j")))


@query("SELECT CAST(bin AS BIGINT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS bin) g LEFT JOIN (SELECT CAST(least(floor(value / 10), 19) AS BIGINT) AS b, count(*) AS n FROM events WHERE value >= 0 AND value <= 200 GROUP BY 1) c ON g.bin = c.b")
def hist_fixed(spark, sf):
    return histogram.histogram(t(spark, sf, "events"), [], "value", 0.0, 200.0, 10.0)


@query("""WITH c AS (SELECT event_type, CAST(least(floor(value / 10), 19) AS BIGINT) AS b, count(*) AS n FROM events WHERE value >= 0 AND value <= 200 GROUP BY 1, 2), s AS (SELECT event_type, sum(n) AS t FROM c GROUP BY 1),
g AS (SELECT event_type, t, unnest(range(0, 20)) AS bin FROM s) SELECT g.event_type, CAST(g.bin AS BIGINT) AS bin, round(coalesce(c.n, 0) / (t * 10.0), 8) AS n FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.b = g.bin""")
def hist_density(spark, sf):
    return rounded(histogram.histogram(t(spark, sf, "events"), ["event_type"], "value", 0.0, 200.0, 10.0, density=True), 8, "n")


@query("""WITH c AS (SELECT CAST(least(floor(value / 10), 19) AS BIGINT) AS b, count(*) AS n FROM events WHERE value >= 0 AND value <= 200 GROUP BY 1), g AS (SELECT unnest(range(0, 20)) AS bin)
SELECT CAST(bin AS BIGINT) AS bin, round(coalesce(n, 0) / (4.0 / 3 * pi() * (power((bin + 1) * 10, 3) - power(bin * 10, 3))), 10) AS n FROM g LEFT JOIN c ON c.b = g.bin""")
def rdf_shell_norm(spark, sf):
    return rounded(histogram.histogram(t(spark, sf, "events"), [], "value", 0.0, 200.0, 10.0, shells=True), 10, "n")


@query("""WITH d AS (SELECT event_type, value AS x, CAST(user_id % 97 AS DOUBLE) AS y FROM events), m AS (SELECT event_type, min(x) x0, max(x) x1, min(y) y0, max(y) y1, count(*) AS t FROM d GROUP BY 1),
c AS (SELECT d.event_type, CAST(least(floor((x - x0) / (x1 - x0) * 10), 9) AS BIGINT) AS ix, CAST(least(floor((y - y0) / (y1 - y0) * 10), 9) AS BIGINT) AS iy, count(*) AS n FROM d JOIN m USING (event_type) GROUP BY 1, 2, 3),
g AS (SELECT event_type, x0, x1, y0, y1, t, a.ix, b.iy FROM m, (SELECT unnest(range(0, 10)) AS ix) a, (SELECT unnest(range(0, 10)) AS iy) b)
SELECT g.event_type, CAST(g.ix AS BIGINT) AS ix, CAST(g.iy AS BIGINT) AS iy, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (t * ((x1 - x0) / 10) * ((y1 - y0) / 10)), 8) AS density FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.ix = g.ix AND c.iy = g.iy""")
def hist2d(spark, sf):
    own = t(spark, sf, "events").withColumn("y", (F.col("user_id") % 97).cast("double"))
    return rounded(histogram.histogram2d(own, ["event_type"], "value", "y", 10, 10), 8, "density")


@query("""WITH d AS (SELECT event_type, value AS x FROM events WHERE value IS NOT NULL), h AS (SELECT event_type, stddev_samp(x) * 0.3 AS h, count(*) AS n FROM d GROUP BY 1), g AS (SELECT unnest(range(0, 11)) AS point)
SELECT event_type, CAST(point AS INTEGER) AS point, round(sum(exp(-power((point * 20.0 - x) / h, 2) / 2) / (h * n * sqrt(2 * pi()))), 8) AS density FROM d JOIN h USING (event_type), g GROUP BY 1, 2""")
def kde_grid(spark, sf):
    return rounded(histogram.kernel_density(t(spark, sf, "events"), ["event_type"], "value", 0.0, 200.0, 11, 0.3), 8, "density")


VOXELS = """v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT label, greatest(0, least(4, floor((e[1] + 0.4) / (0.8 / 5)))) AS vx, greatest(0, least(4, floor((e[2] + 0.4) / (0.8 / 5)))) AS vy, greatest(0, least(4, floor((e[3] + 0.4) / (0.8 / 5)))) AS vz, e[4] AS q FROM v),
c AS (SELECT label, vx, vy, vz, count(*) AS n, avg(q) AS m FROM p GROUP BY ALL), s AS (SELECT label, count(*) AS t FROM p GROUP BY 1),
g AS (SELECT label, t, a.x AS vx, b.x AS vy, d.x AS vz FROM s, (SELECT unnest(range(0, 5)) AS x) a, (SELECT unnest(range(0, 5)) AS x) b, (SELECT unnest(range(0, 5)) AS x) d)"""


@query(f"""WITH {VOXELS} SELECT g.label, CAST(g.vx AS BIGINT) AS vx, CAST(g.vy AS BIGINT) AS vy, CAST(g.vz AS BIGINT) AS vz, CASE WHEN n > 0 THEN 1 ELSE 0 END AS "binary", round(coalesce(n, 0) / t, 8) AS density, round(coalesce(m, 0), 8) AS mean
FROM g LEFT JOIN c ON c.label = g.label AND c.vx = g.vx AND c.vy = g.vy AND c.vz = g.vz""")
def voxel_binary_density_mean(spark, sf):
    e = F.col("embedding")
    own = t(spark, sf, "embeddings").select("label", *[e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "q"))])
    return rounded(histogram.voxels(own, ["label"], ("x", "y", "z"), ((-0.4, 0.4),) * 3, 5, "q"), 8, "density", "mean")


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), r AS (SELECT unnest(range(-1, 3)) AS n),
m AS (SELECT vec_id, a.n AS i, b.n AS j, c.n AS k, x + a.n * 1.0 + b.n * 0.2 AS xm, y + b.n * 1.5 AS ym, z + c.n * 2.0 AS zm FROM p, r a, r b, r c)
SELECT i, j, k, count(*) AS n, round(sum(xm), 4) AS sx FROM m WHERE xm BETWEEN 0 AND 2 AND ym BETWEEN 0 AND 2 AND zm BETWEEN 0 AND 2 GROUP BY 1, 2, 3""")
def supercell_expand(spark, sf):
    e = F.col("embedding")
    own = t(spark, sf, "embeddings").select("vec_id", *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    out = pairs.supercell(own, ((1.0, 0.0, 0.0), (0.2, 1.5, 0.0), (0.0, 0.0, 2.0)), 2.0, reach=(-1, 2))
    return out.groupBy(*[F.col(c).cast("long").alias(c) for c in "ijk"]).agg(F.count("*").alias("n"), F.round(F.sum("x_moved"), 4).alias("sx"))


DIAGRAM = "d AS (SELECT user_id % 20 AS id, CAST(event_id % 3 AS BIGINT) AS dim, value AS birth, value + 1 + event_id % 13 AS death FROM events)"


def _diagrams(spark, sf):
    return t(spark, sf, "events").select((F.col("user_id") % 20).alias("id"), (F.col("event_id") % 3).alias("dim"), F.col("value").alias("birth"), (F.col("value") + 1 + F.col("event_id") % 13).alias("death"))


@query(f"""WITH {DIAGRAM}, l AS (SELECT id, dim, 'birth' AS quantity, birth AS v FROM d UNION ALL SELECT id, dim, 'death', death FROM d UNION ALL SELECT id, dim, 'persistence', death - birth FROM d)
SELECT id, dim, quantity, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM l GROUP BY 1, 2, 3""")
def persistence_stats(spark, sf):
    return rounded(topology.diagram_stats(_diagrams(spark, sf), ["id", "dim"], ("min", "max", "mean", "std")), 6, "min", "max", "mean", "std")


@query(f"""WITH {DIAGRAM}, e AS (SELECT dim, birth AS x, death - birth AS y FROM d), m AS (SELECT dim, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM e GROUP BY 1),
c AS (SELECT e.dim, CAST(least(floor((x - x0) / (x1 - x0) * 8), 7) AS BIGINT) AS ix, CAST(least(floor((y - y0) / (y1 - y0) * 6), 5) AS BIGINT) AS iy, count(*) AS n FROM e JOIN m USING (dim) GROUP BY 1, 2, 3)
SELECT m.dim, CAST(a.i AS BIGINT) AS ix, CAST(b.i AS BIGINT) AS iy, coalesce(n, 0) AS n FROM m CROSS JOIN (SELECT unnest(range(0, 8)) AS i) a CROSS JOIN (SELECT unnest(range(0, 6)) AS i) b LEFT JOIN c ON c.dim = m.dim AND c.ix = a.i AND c.iy = b.i""")
def persistence_hist(spark, sf):
    return topology.diagram_histogram(_diagrams(spark, sf), ["dim"], 8, 6).drop("density")


@query(f"""WITH {DIAGRAM}, g AS (SELECT a.i AS px, b.i AS py FROM (SELECT unnest(range(0, 5)) AS i) a, (SELECT unnest(range(0, 5)) AS i) b)
SELECT dim, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(sum((death - birth) * exp(-(power(px * (200.0 / 4) - birth, 2) + power(py * (14.0 / 4) - (death - birth), 2)) / 50.0)), 4) AS v FROM d, g GROUP BY 1, 2, 3""")
def persistence_image(spark, sf):
    return rounded(topology.images(_diagrams(spark, sf), ["dim"], (5, 5), 5.0, 200.0, 14.0), 4, "v")


@query(f"WITH {DIAGRAM} SELECT dim, round(max(birth) * 1.1, 6) AS max_birth, round(max(death - birth) * 1.1, 6) AS max_persistence FROM d GROUP BY 1")
def image_limits_fit(spark, sf):
    return rounded(topology.image_limits(_diagrams(spark, sf)), 6, "max_birth", "max_persistence")


@query(f"WITH {DIAGRAM} SELECT dim, min(struct_pack(a := round(power(birth - 50, 2) + power(death - birth - 3, 2), 6), id := id)).id AS id FROM d GROUP BY 1")
def nearest_diagram_point(spark, sf):
    own = topology.with_persistence(_diagrams(spark, sf))
    d = F.round((F.col("birth") - 50) * (F.col("birth") - 50) + (F.col("persistence") - 3) * (F.col("persistence") - 3), 6)
    return own.groupBy("dim").agg(F.min(F.struct(d.alias("a"), F.col("id"))).alias("m")).select("dim", "m.id")


@query("""WITH k AS (SELECT DISTINCT l_orderkey % 1000 AS k FROM lineitem), r AS (SELECT unnest(['A', 'N', 'R', 'X']) AS role), a AS (SELECT l_orderkey % 1000 AS k, l_returnflag AS role, avg(l_tax) AS mean, max(l_tax) AS max FROM lineitem GROUP BY 1, 2)
SELECT k.k AS id, r.role, 'mean' AS agg, round(mean, 6) AS value FROM k CROSS JOIN r LEFT JOIN a ON a.k = k.k AND a.role = r.role UNION ALL SELECT k.k, r.role, 'max', round(max, 6) FROM k CROSS JOIN r LEFT JOIN a ON a.k = k.k AND a.role = r.role""")
def bu_groupwise_features(spark, sf):
    own = t(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("id"), "l_returnflag", "l_tax")
    return rounded(groupwise.by_role(own, "id", "l_returnflag", "l_tax", ("A", "N", "R", "X"), ("mean", "max")), 6, "value")


@query("SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_tax END) AS host, round(avg(CASE WHEN l_linenumber <> 1 THEN l_tax END), 6) AS guest_mean, max(CASE WHEN l_linenumber <> 1 THEN l_tax END) AS guest_max FROM lineitem GROUP BY 1")
def host_guest_features(spark, sf):
    own = t(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, "host").otherwise("guest").alias("role"), "l_tax")
    return rounded(groupwise.host_and_guests(own, "l_orderkey", "role", "l_tax", ("mean", "max")), 6, "guest_mean")


@query("SELECT user_id, coalesce(event_type, 'all') AS event_type, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))")
def species_groupwise_all(spark, sf):
    return rounded(groupwise.by_species_and_all(t(spark, sf, "events"), ["user_id"], "event_type", "value", ("mean", "max")), 6, "mean")


@query("SELECT l_orderkey, round(avg(p_size), 6) AS p_size_mean, round(stddev_pop(p_size), 6) AS p_size_std, round(avg(p_retailprice), 6) AS p_retailprice_mean, round(stddev_pop(p_retailprice), 6) AS p_retailprice_std FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def composition_stats(spark, sf):
    sites = t(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("symbol"))
    table = t(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), "p_size", "p_retailprice")
    out = groupwise.composition(sites, "l_orderkey", table, ("p_size", "p_retailprice"), ("mean", "std"))
    return rounded(out, 6, *out.columns[1:])


@query("SELECT lang, max(version) AS version FROM (SELECT lang, source AS version FROM documents) GROUP BY lang")
def max_version(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(F.max("source").alias("version"))


@query("SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def last_wins_map(spark, sf):
    return relational.last_by_key(t(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey")
