"""Queries over splits, metrics, benchmarks, parsers and shapes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import scalars
from latticework.operators import shape, topology
from latticework.plans import bench, clusters, metrics, splits
from latticework.plans.queries_data import rounded, t
from latticework.sources import text_tables

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def orders(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus")


LABEL = "CASE WHEN r < floor({n} * 0.7 + 1e-9) THEN 'train' WHEN r < floor({n} * 0.7 + 1e-9) + least({n} - floor({n} * 0.7 + 1e-9), ceil({n} * 0.1 - 1e-9)) THEN 'valid' ELSE 'test' END"
BINS = "q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders), b AS (SELECT o_orderkey, o_custkey, o_totalprice, (o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT AS bin FROM orders, q)"


@query(f"WITH {BINS} SELECT o_orderkey, bin FROM b")
def quantile_bins(spark, sf):
    return splits.quantile_bin(orders(spark, sf), "o_totalprice").select("o_orderkey", "bin")


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {LABEL.format(n='n')} AS split FROM r")
def split_random(spark, sf):
    return splits.split_random(orders(spark, sf), "o_orderkey", 0.7, 0.1, 42).select("o_orderkey", "split")


GROUPED = """WITH g AS (SELECT DISTINCT {g} AS g FROM orders), r AS (SELECT g, row_number() OVER (ORDER BY md5('42:' || g), g) - 1 AS r, count(*) OVER () AS n FROM g), s AS (SELECT g, {label} AS split FROM r) SELECT o_orderkey, split FROM orders JOIN s ON {g} = g"""


@query(GROUPED.format(g="o_custkey", label=LABEL.format(n="n")))
def split_grouped(spark, sf):
    return splits.split_grouped(orders(spark, sf), "o_custkey", 0.7, 0.1, 42).select("o_orderkey", "split")


@query(GROUPED.format(g="md5(CAST(o_custkey % 100 AS VARCHAR))", label=LABEL.format(n="n")))
def split_hash(spark, sf):
    own = orders(spark, sf).withColumn("hash", F.md5((F.col("o_custkey") % 100).cast("string")))
    return splits.split_grouped(own, "hash", 0.7, 0.1, 42).select("o_orderkey", "split")


@query(f"""WITH {BINS}, r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY bin) AS n FROM b)
SELECT o_orderkey, {LABEL.format(n='n')} AS split FROM r""")
def split_stratified(spark, sf):
    own = splits.quantile_bin(orders(spark, sf), "o_totalprice")
    return splits.split_stratified(own, "o_orderkey", "bin", 0.7, 0.1, 42).select("o_orderkey", "split")


GROUP_BINS = """c AS (SELECT o_custkey, quantile_cont(o_totalprice, 0.5) AS c FROM orders GROUP BY 1), q AS (SELECT quantile_cont(c, [0.25, 0.5, 0.75]) AS q FROM c),
b AS (SELECT o_custkey, (c > q[1])::INT + (c > q[2])::INT + (c > q[3])::INT AS bin FROM c, q),
r AS (SELECT o_custkey, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || o_custkey), o_custkey) - 1 AS r, count(*) OVER (PARTITION BY bin) AS n FROM b)"""


@query(f"WITH {GROUP_BINS}, s AS (SELECT o_custkey, {LABEL.format(n='n')} AS split FROM r) SELECT o_orderkey, split FROM orders JOIN s USING (o_custkey)")
def split_grouped_stratified(spark, sf):
    return splits.split_grouped_stratified(orders(spark, sf), "o_custkey", "o_totalprice", 0.7, 0.1, 42).select("o_orderkey", "split")


BY_BINS = """WITH q AS (SELECT quantile_cont({x}, [1.0 / 3, 2.0 / 3]) AS q FROM orders), b AS (SELECT o_orderkey, ({x} > q[1])::INT + ({x} > q[2])::INT AS g FROM orders, q), g AS (SELECT DISTINCT g FROM b),
r AS (SELECT g, row_number() OVER (ORDER BY md5('42:' || g), g) - 1 AS r, count(*) OVER () AS n FROM g), s AS (SELECT g, {label} AS split FROM r) SELECT o_orderkey, split FROM b JOIN s USING (g)"""


@query(BY_BINS.format(x="o_totalprice", label=LABEL.format(n="n")))
def split_density(spark, sf):
    return splits.split_by_quantiles(orders(spark, sf), "o_totalprice", 0.7, 0.1, 42).select("o_orderkey", "split")


@query(BY_BINS.format(x="year(o_orderdate)", label=LABEL.format(n="n")))
def split_time(spark, sf):
    return splits.split_by_quantiles(orders(spark, sf), "year", 0.7, 0.1, 42).select("o_orderkey", "split")


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {LABEL.format(n='n')} AS split FROM r")
def split_time_ordered(spark, sf):
    return splits.split_ordered(orders(spark, sf), "o_orderkey", "year", 0.7, 0.1).select("o_orderkey", "split")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r""")
def kfold_plain(spark, sf):
    return splits.fold_plain(orders(spark, sf), "o_orderkey", 7, 7).select("o_orderkey", "fold")


@query("""WITH g AS (SELECT DISTINCT o_custkey AS g FROM orders), r AS (SELECT g, CAST((row_number() OVER (ORDER BY md5('7:' || g), g) - 1) % 5 AS INTEGER) AS fold FROM g) SELECT o_orderkey, fold FROM orders JOIN r ON o_custkey = g""")
def kfold_grouped(spark, sf):
    return splits.fold_grouped(orders(spark, sf), "o_custkey", 5, 7).select("o_orderkey", "fold")


@query(f"WITH {BINS} SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY bin ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM b")
def kfold_stratified(spark, sf):
    return splits.fold_stratified(splits.quantile_bin(orders(spark, sf), "o_totalprice"), "o_orderkey", "bin", 5, 7).select("o_orderkey", "fold")


@query(f"WITH {GROUP_BINS} SELECT o_orderkey, CAST(r % 5 AS INTEGER) AS fold FROM orders JOIN r USING (o_custkey)")
def kfold_stratified_grouped(spark, sf):
    return splits.fold_grouped_stratified(orders(spark, sf), "o_custkey", "o_totalprice", 5, 42).select("o_orderkey", "fold")


@query()
def kfold_grouped_even(spark, sf):
    return splits.fold_grouped_even(orders(spark, sf), "o_custkey", 5).select("o_orderkey", "fold")


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('3:' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus FROM r WHERE r <= floor(n * 0.3 + 1e-9)""")
def downsample_hash(spark, sf):
    return splits.downsample(orders(spark, sf), "o_orderkey", "o_orderstatus", 0.3, 3).select("o_orderkey", "o_orderstatus")


@query("""WITH s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY 1) SELECT o_orderkey, CASE r WHEN 1 THEN 'train' WHEN 2 THEN 'valid' ELSE 'test' END AS o_orderstatus FROM orders JOIN s USING (o_orderstatus)""")
def sort_splits_by_size(spark, sf):
    return splits.relabel_by_size(orders(spark, sf), "o_orderstatus").select("o_orderkey", "o_orderstatus")


def _vectors(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query()
def kennard_stone_order(spark, sf):
    return shape.kennard_stone_order(_vectors(spark, sf), "vec_id", "e", "label")


@query()
def cluster_split(spark, sf):
    return clusters.split_clusters(_vectors(spark, sf), "e", 4, 0.7, 0.1).select("vec_id", "cluster", "split")


@query()
def cluster_stratified(spark, sf):
    return clusters.split_within_clusters(_vectors(spark, sf), "vec_id", "e", 4, 0.7, 0.1).select("vec_id", "cluster", "split")


@query()
def lococv(spark, sf):
    return clusters.leave_cluster_out(_vectors(spark, sf), "e", 3).select("vec_id", "cluster", "split")


@query()
def diagram_vectors(spark, sf):
    own = t(spark, sf, "events").select((F.col("user_id") % 20).alias("id"), F.col("value").alias("birth"), (F.col("event_id") % 13).cast("double").alias("persistence"))
    return clusters.diagram_vectors(own, "id", ["birth", "persistence"], 3)


PREDICTED = "p AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS y, avg(l_extendedprice) OVER (PARTITION BY l_returnflag, l_quantity) AS p FROM lineitem)"
ERRORS = """round(avg((y - p) * (y - p)), 1) AS mean_squared_error, round(avg(abs(y - p)), 4) AS mean_absolute_error, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2_score, round(max(abs(y - p)), 4) AS max_error,
round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mean_absolute_percentage_error"""


def _predicted(spark, sf):
    own = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.col("l_extendedprice").alias("y"))
    return metrics.predict_group_mean(own, own, "y", by=["l_returnflag", "l_quantity"])


def _rounded_errors(df):
    return rounded(rounded(rounded(df, 1, "mean_squared_error"), 4, "mean_absolute_error", "max_error"), 6, "r2_score", "mean_absolute_percentage_error")


@query(f"WITH {PREDICTED} SELECT {ERRORS} FROM p")
def regression_metrics(spark, sf):
    return _rounded_errors(metrics.regression_metrics(_predicted(spark, sf), "y", "prediction"))


FOLDS = f"""{GROUP_BINS}, o AS (SELECT o_orderkey, o_totalprice AS y, o_orderpriority AS g, r % 5 AS fold FROM orders JOIN r USING (o_custkey)), f AS (SELECT unnest(range(0, 5)) AS fold),
m AS (SELECT f.fold, g, avg(y) AS p FROM f JOIN o ON o.fold <> f.fold GROUP BY 1, 2), p AS (SELECT o.fold, y, p FROM o JOIN m ON m.fold = o.fold AND m.g = o.g)"""


@query(f"WITH {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, {ERRORS} FROM p GROUP BY fold")
def metrics_by_fold(spark, sf):
    """Grouped and stratified folds, the mean of the other folds' rows of the same priority as a prediction, and its metrics in each fold."""
    return _rounded_errors(_fold_errors(spark, sf))


def _fold_errors(spark, sf):
    own = splits.fold_grouped_stratified(orders(spark, sf), "o_custkey", "o_totalprice", 5, 42)
    sums = own.groupBy("o_orderpriority", "fold").agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n"))
    # A fold's training mean is all sums less its own.
    whole = sums.groupBy(F.col("o_orderpriority").alias("g")).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    mean = sums.join(whole, F.col("o_orderpriority") == F.col("g")).select("g", F.col("fold").alias("f"), ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("prediction"))
    met = own.join(mean, (F.col("o_orderpriority") == F.col("g")) & (F.col("fold") == F.col("f")))
    return metrics.regression_metrics(met, "o_totalprice", "prediction", ["fold"])


@query(f"""WITH {FOLDS}, e AS (SELECT fold, avg(abs(y - p)) AS mae, max(abs(y - p)) AS me FROM p GROUP BY fold)
SELECT round(avg(mae), 4) AS mean_absolute_error_mean, round(stddev_pop(mae), 3) AS mean_absolute_error_std, round(avg(me), 4) AS max_error_mean, round(stddev_pop(me), 3) AS max_error_std FROM e""")
def metrics_mean_std(spark, sf):
    out = metrics.mean_and_std(_fold_errors(spark, sf), ("mean_absolute_error", "max_error"))
    return rounded(rounded(out, 4, "mean_absolute_error_mean", "max_error_mean"), 3, "mean_absolute_error_std", "max_error_std")


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS p FROM orders), n AS (SELECT unnest([5, 10, 50, 100, 500]) AS n),
a AS (SELECT k, row_number() OVER (ORDER BY y DESC, k) AS ry, row_number() OVER (ORDER BY p DESC, k) AS rp FROM o) SELECT n AS k, n, count(*) FILTER (WHERE ry <= n AND rp <= n) AS hits FROM a, n GROUP BY n""")
def top_n_in_top_k(spark, sf):
    own = t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("p"))
    outs = [metrics.top_n_in_top_k(own, "key", "y", "p", n, n) for n in metrics.TOPS]
    out = outs[0]
    for o in outs[1:]:
        out = out.union(o)
    return out


@query("""WITH l AS (SELECT l_quantity AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM l)
SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r""")
def adversarial_auc_rank(spark, sf):
    own = t(spark, sf, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(metrics.auc_by_rank(own, "l_quantity", "y"), 6, "auc")


@query()
def adversarial_rf(spark, sf):
    own = t(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    scores, gain = metrics.adversarial(own.where("l_returnflag = 'R'").drop("l_returnflag"), own.where("l_returnflag = 'A'").drop("l_returnflag"), ["l_quantity", "l_extendedprice", "l_discount"], "id", k=2)
    return spark.createDataFrame([(f"auc_{i}", float(s)) for i, s in enumerate(scores)] + [(f"importance_{k}", v) for k, v in gain.items()], "name string, value double")


@query("""SELECT feature, round(correlation, 6) AS correlation FROM (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS correlation FROM lineitem UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem)""")
def corr_pearson(spark, sf):
    return rounded(metrics.pearson(t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 6, "correlation")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS correlation FROM r""")
def corr_spearman(spark, sf):
    return rounded(metrics.spearman(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), 6, "correlation")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem")
def zscore(spark, sf):
    return rounded(metrics.zscore(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]), 6, "l_quantity")


@query("""SELECT raw, CASE raw WHEN '10–20' THEN 15.0 WHEN 'Not traded.' THEN NULL WHEN 'Negative price.' THEN 0.0 WHEN '3.5' THEN 3.5 END AS price FROM (SELECT unnest(['10–20', 'Not traded.', 'Negative price.', '3.5', 'x']) AS raw)""")
def price_clean(spark, sf):
    return spark.createDataFrame([(x,) for x in ("10–20", "Not traded.", "Negative price.", "3.5", "x")], "raw string").select("raw", scalars.clean_price(F.col("raw")).alias("price"))


@query(r"""SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '"k":\s+(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS k FROM events""")
def kv_regex_extract(spark, sf):
    return t(spark, sf, "events").select("event_id", scalars.key_value(F.col("props"), '"k"').alias("k"))


@query(r"""WITH l AS (SELECT page_id, unnest(string_split(html, '</p>')) AS line, unnest(range(0, len(string_split(html, '</p>')))) AS pos FROM pages),
m AS (SELECT *, CASE WHEN regexp_matches(line, '<footer') THEN 'end' WHEN regexp_matches(line, '<article') THEN 'text' WHEN regexp_matches(line, '<nav') THEN 'menu' END AS o FROM l),
s AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM m) SELECT page_id, section, count(*) AS n FROM s GROUP BY 1, 2""")
def log_section_parse(spark, sf):
    own = t(spark, sf, "pages").select("page_id", F.replace("html", F.lit("</p>"), F.lit("\n")).alias("text"), F.col("html").alias("h"))
    own = own.select("page_id", F.array_join(F.transform(F.split("h", "</p>"), lambda x: F.translate(x, "\n", " ")), "\n").alias("text"))
    return text_tables.log_sections(own, "page_id", {"menu": "<nav", "text": "<article", "end": "<footer"}).groupBy("page_id", "section").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y, CAST(NULL AS DOUBLE) AS z, l_discount AS energy FROM lineitem")
def grid_text_parse(spark, sf):
    text = F.concat_ws("  ", "l_quantity", "l_extendedprice", F.lit("?"), "l_discount", F.lit("1"), F.lit("2"), F.lit("3"))
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("value"))
    return text_tables.parse_grid(lines, "value", ("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "x", "y", "z", "energy")


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k", event_type AS "about.type" FROM events""")
def flatten_json(spark, sf):
    from latticework.operators.relational import flatten

    own = t(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("props"), F.struct(F.col("event_type").alias("type")).alias("about"))
    return flatten(own)


FF = (("O_co2", 79.0, 3.05), ("C_co2", 27.0, 2.8), ("N_n2", 36.0, 3.31))


@query(f"""WITH f AS (SELECT * FROM (VALUES {", ".join(str(r) for r in FF)}) v(atom, eps, sigma)) SELECT a.atom AS a, b.atom AS b, round(sqrt(a.eps * b.eps), 6) AS eps, round((a.sigma + b.sigma) / 2, 6) AS sigma FROM f a JOIN f b ON a.atom <= b.atom""")
def lj_mixing(spark, sf):
    own = spark.createDataFrame(FF, "atom string, eps double, sigma double")
    a, b = own.select(*[F.col(c).alias(f"{c}_a") for c in own.columns]), own.select(*[F.col(c).alias(f"{c}_b") for c in own.columns])
    eps, sigma = scalars.lorentz_berthelot(F.col("eps_a"), F.col("sigma_a"), F.col("eps_b"), F.col("sigma_b"))
    return a.join(F.broadcast(b), F.col("atom_a") <= F.col("atom_b")).select(F.col("atom_a").alias("a"), F.col("atom_b").alias("b"), F.round(eps, 6).alias("eps"), F.round(sigma, 6).alias("sigma"))


@query("SELECT c_custkey, 'R' || substr(c_name, 1, 4) || substr(translate(to_base64(unhex(sha1(c_name || c_mktsegment))), '+/', '-_'), 1, 4) || '20240101000000' AS report_id FROM customer")
def report_id(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", bench.report_id(F.col("c_name"), F.col("c_mktsegment"), F.lit("20240101000000")).alias("report_id"))


@query(f"""WITH {FOLDS}, e AS (SELECT fold, avg(abs(y - p)) AS a, max(abs(y - p)) AS m FROM p GROUP BY fold), u AS (SELECT 'plain' AS name, * FROM e UNION ALL SELECT 'double', fold, a * 2, m * 2 FROM e)
SELECT name, round(avg(a), 3) AS mean_absolute_error_mean, round(stddev_pop(a), 2) AS mean_absolute_error_std FROM u GROUP BY 1""")
def leaderboard(spark, sf):
    folds = _fold_errors(spark, sf)
    own = folds.withColumn("name", F.lit("plain")).unionByName(folds.withColumn("name", F.lit("double")).withColumn("mean_absolute_error", F.col("mean_absolute_error") * 2))
    out = metrics.mean_and_std(own, ("mean_absolute_error",), ["name"])
    return rounded(rounded(out, 3, "mean_absolute_error_mean"), 2, "mean_absolute_error_std")


@query("""SELECT s_suppkey, 'a' AS gas, map {'acctbal': s_acctbal, 'nation': CAST(s_nationkey AS DOUBLE)}['acctbal'] AS acctbal, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier""")
def unpivot_gas_property(spark, sf):
    wide = t(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a-acctbal"), F.col("s_nationkey").cast("double").alias("a-nation"))
    long = wide.unpivot(["s_suppkey"], ["a-acctbal", "a-nation"], "name", "value")
    part = long.select("s_suppkey", F.split("name", "-")[0].alias("gas"), F.split("name", "-")[1].alias("prop"), "value")
    maps = part.groupBy("s_suppkey", "gas").agg(F.map_from_entries(F.collect_list(F.struct("prop", "value"))).alias("m"))
    return maps.select("s_suppkey", "gas", F.col("m")["acctbal"].alias("acctbal"), F.col("m")["nation"].alias("nation"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, 'This has ' || string_agg(n || ' of ' || l_returnflag, ', ' ORDER BY l_returnflag) || '.' AS sentence FROM c GROUP BY 1""")
def fragment_counter_text(spark, sf):
    count = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "n"))), lambda s: F.format_string("%d of %s", s.getField("n"), s.getField("l_returnflag")))
    return count.groupBy("l_orderkey").agg(F.format_string("This has %s.", F.array_join(parts, ", ")).alias("sentence"))


@query()
def shape_descriptors(spark, sf):
    e = F.col("embedding")
    return shape.shape_descriptors(t(spark, sf, "embeddings").select("label", *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")]), "label")


@query()
def h0_persistence(spark, sf):
    e = F.col("embedding")
    return topology.h0_diagrams(t(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("g"), *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")]), "g")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) AS q, o_orderstatus AS name FROM orders GROUP BY 2) SELECT name, round(q[1], 4) AS lo, round(q[3], 4) AS mid, round(q[5], 4) AS hi FROM q""")
def box_numbers(spark, sf):
    own = bench.five_numbers(t(spark, sf, "orders").select(F.col("o_orderstatus").alias("name"), "o_totalprice"), "o_totalprice")
    return own.select("name", *[F.round(F.col("box")[i], 4).alias(n) for i, n in ((0, "lo"), (2, "mid"), (4, "hi"))])


@query("""WITH v AS (SELECT vec_id % 50 AS s, vec_id AS i, CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS y, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT unnest([-1.0, 0.0, 1.0]) AS n), d AS (SELECT a.s, a.y AS ya, b.y AS yb, min(sqrt(power((b.e[1] - a.e[1] + p.n) * 4, 2) + power((b.e[2] - a.e[2] + q.n) * 4, 2) + power((b.e[3] - a.e[3] + r.n) * 4, 2))) AS d
FROM v a JOIN v b ON a.s = b.s AND a.i < b.i, g p, g q, g r GROUP BY a.s, a.i, b.i, a.y, b.y),
w AS (SELECT s, least(floor((d - 0.2) / 0.25), 10) AS bin, d, (CASE WHEN ya = 'A' THEN 2.0 ELSE 3.0 END) * (CASE WHEN yb = 'A' THEN 2.0 ELSE 3.0 END) AS p FROM d WHERE d < 3.0 AND d > 0.2)
SELECT CAST(s AS VARCHAR) AS struct_id, 'aprdf_X_product_' || CAST(bin AS INTEGER) AS feature, round(sum(p * exp(-10 * power(d - (0.2 + bin * (2.8 / 10)), 2))), 6) AS value FROM w GROUP BY 1, 2""")
def aprdf_periodic(spark, sf):
    from latticework.operators import featurizers

    e = F.col("embedding")
    sites = t(spark, sf, "embeddings").select((F.col("vec_id") % 50).cast("string").alias("struct_id"), F.col("vec_id").alias("site_id"), F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("symbol"), *[e[i].cast("double").alias(n) for i, n in enumerate(("fx", "fy", "fz"))])
    cell = F.array(*[F.array(*[F.lit(4.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    structures = sites.select("struct_id").distinct().withColumn("lattice", cell)
    properties = spark.createDataFrame([("A", 2.0), ("B", 3.0)], "symbol string, X double")
    out = featurizers.aprdf(structures, sites, properties, ("X",), ("product",), 3.0, 0.2, 0.25, 10.0)
    return rounded(out.long().where("value <> 0"), 6, "value")
