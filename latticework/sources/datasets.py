"""Versioned datasets: a registry of specifications and one pipeline that loads, cleans and checks them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.relational import check_choice, drop_nulls, expect_rows, file_stem, keep_first_in_turn, where_flavor
from latticework.shared import ranked


@dataclass(frozen=True)
class DatasetSpec:
    """What a dataset's pipeline needs to know. Flavors map to their expected rows."""

    name: str
    expected: int
    structure_name: str = "info.name"
    base_name: str | None = "info.basename"
    graph_hash: str = "info.decorated_graph_hash"
    order: str | None = None
    year: str | None = "info.year"
    drop_nulls: bool = True
    flavors: dict[str, int] = field(default_factory=dict)


# The published sizes before deduplication.
REGISTRY = {
    "arabg": DatasetSpec("arabg", 370, base_name=None, year=None),
    "arcmof": DatasetSpec("arcmof", 22452, base_name=None, year=None),
    "bw": DatasetSpec("bw", 17970, base_name=None, year=None),
    "core": DatasetSpec("core", 5393, structure_name="info.CoRE_name"),
    "qmof": DatasetSpec("qmof", 15042, structure_name="info.qmof_id", order="outputs.pbe.energy_total", drop_nulls=False, flavors={"all": 15042, "csd": 6311, "gcmc": 5321, "csd-gcmc": 2295}),
    "thermal_stability": DatasetSpec("thermal_stability", 2039, drop_nulls=False),
}


def load(spark: SparkSession, spec: DatasetSpec, path: str, flavor: str | None = None, check: bool = True, drop_base_duplicates: bool = True, drop_graph_duplicates: bool = True, drop_null_rows: bool | None = None) -> DataFrame:
    """The dataset's rows with row_id, the position in a fixed order. path holds JSON lines or, ending in .parquet, Parquet."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    if flavor:
        check_choice(flavor, tuple(spec.flavors), "flavor")
        if flavor != "all":
            df = where_flavor(df, flavor)
    if check:
        expect_rows(df, spec.flavors.get(flavor or "", spec.expected))
    order = ([F.col(f"`{spec.order}`").asc_nulls_last()] if spec.order else []) + [F.col(f"`{spec.structure_name}`")]
    sortable = [F.when(F.col(f"`{spec.order}`").isNull(), 1).otherwise(0), F.col(f"`{spec.order}`"), order[-1]] if spec.order else order
    keys = [f"`{spec.base_name}`"] * bool(spec.base_name and drop_base_duplicates) + [f"`{spec.graph_hash}`"] * drop_graph_duplicates
    df = keep_first_in_turn(df, [F.col(k) for k in keys], sortable)
    if spec.drop_nulls if drop_null_rows is None else drop_null_rows:
        df = drop_nulls(df, "features.", "info.")
    return ranked(df, *order, name="row_id")


def with_files(df: DataFrame, spec: DatasetSpec, folder: str, ending: str = "cif") -> DataFrame:
    return df.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), F.col(f"`{spec.structure_name}`"), F.lit(f".{ending}")))


def from_files(files: DataFrame, frame: DataFrame, name: str) -> DataFrame:
    """The frame's rows that have a file, with it: joined by the file's stem, never by position."""
    return frame.join(files.select(file_stem(F.col("path")).alias("__stem"), F.col("path").alias("file")), F.col(f"`{name}`") == F.col("__stem")).drop("__stem")
