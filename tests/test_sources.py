import pytest
from pyspark.sql import functions as F

from latticework.plans import bench, metrics, splits
from latticework.sources import structures, text_tables
from latticework.streaming.resume import featurize_stream

CIF = """data_test
_cell_length_a 10.0(1)
_cell_length_b 10
_cell_length_c 20
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_charge
Cu1 Cu 0.5 0.25 0.1 0.8
O1 O 0 0 0 -0.4
"""


def test_cif(spark, tmp_path):
    (tmp_path / "A.cif").write_text(CIF)
    (tmp_path / "B.cif").write_text("data_x\n")
    found, sites = structures.read_cif(spark, str(tmp_path))
    assert {r.struct_id: r._error is None for r in found.collect()} == {"A": True, "B": False}
    first = sites.orderBy("site_id").first()
    assert (first.symbol, first.charge) == ("Cu", 0.8) and (first.x, first.y, first.z) == pytest.approx((5, 2.5, 2))


def test_pore_reports(spark):
    text = "@ a.res Unitcell_volume: 307.484   Density: 1.62239   ASA_A^2: 60.7713 ASA_m^2/cm^3: 1976.4 ASA_m^2/g: 1218.21 NASA_A^2: 0"
    row = text_tables.parse_surface(spark.createDataFrame([(text,)], "text string")).first()
    # A published report.
    assert (row.density, row.asa_m2g, row.nasa_a2) == (1.62239, 1218.21, 0)
    pores = text_tables.parse_pores(spark.createDataFrame([("a.res 1.70107 0.95106 1.64805",)], "text string")).first()
    assert pores.lis == 1.70107


def test_grid(spark):
    df = spark.createDataFrame([("1 2 3 -4.5 ? ? 0",), ("x",)], "value string")
    row = text_tables.parse_grid(df).collect()
    assert len(row) == 1 and row[0].energy == -4.5 and row[0].deriv_x is None


def test_report_round_trip(spark, tmp_path):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 3 + 0.01 * F.col("id")).alias("y"))
    task = bench.Task("T", "y", lambda d, k: splits.fold_plain(d, "id", k), k=2)
    report = bench.run(spark, task, df, bench.GroupMean(by=["g"]), "id", "group-mean", version="v1", implementation="here")
    bench.save_json(report, str(tmp_path / "r"))
    back = spark.read.schema(bench.REPORT).json(str(tmp_path / "r"))
    board = bench.leaderboard(back)
    assert board.count() == 2 and bench.summary(board).first().r2_score_mean > 0.8
    assert "group-mean" in bench.model_card(back).first().card


def test_adversarial_and_auc(spark):
    a = spark.range(200).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 7 % 13).cast("double").alias("n"))
    b = a.withColumn("x", F.col("x") + 500)
    scores, gain = metrics.adversarial(a, b, ["x", "n"], "k", k=2)
    assert min(scores) > 0.95 and gain["x"] > gain["n"]
    assert metrics.auc_by_rank(metrics.labelled_union(a, b), "x", "label").first().auc == 1
    assert metrics.auc_by_rank(metrics.labelled_union(a, a), "x", "label").first().auc == pytest.approx(0.5)


def test_stream_takes_each_file_once(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.range(5).write.parquet(at)
    make = lambda: featurize_stream(spark, at, spark.range(1).schema, lambda d: d.withColumn("f", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    make()
    spark.range(5, 8).write.mode("append").parquet(at)
    make()
    assert sorted(r.f for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8, 10, 12, 14]
