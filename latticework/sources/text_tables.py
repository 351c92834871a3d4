"""Readers of the text formats that simulators and geometry programs write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions.scalars import clean_abundance, clean_price, key_value, number_or_null

GRID = ("x", "y", "z", "energy", "deriv_x", "deriv_y", "deriv_z")
# The labels of a pore program's reports, by the field's name.
SURFACE = {"unitcell_volume": "Unitcell_volume", "density": "Density", "asa_a2": r"ASA_A\^2", "asa_m2cm3": r"ASA_m\^2/cm\^3", "asa_m2g": r"ASA_m\^2/g", "nasa_a2": r"NASA_A\^2", "nasa_m2cm3": r"NASA_m\^2/cm\^3", "nasa_m2g": r"NASA_m\^2/g"}
VOLUME = {"unitcell_volume": "Unitcell_volume", "density": "Density", "av_a3": r"AV_A\^3", "av_volume_fraction": "AV_Volume_fraction", "av_cm3g": r"AV_cm\^3/g", "nav_a3": r"NAV_A\^3", "nav_volume_fraction": "NAV_Volume_fraction", "nav_cm3g": r"NAV_cm\^3/g"}
POSITIONAL = ("lis", "lifs", "lifsp")


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, text) of every file below path, name without its ending."""
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return read.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("name"), F.col("value").alias("text"))


def parse_grid(lines: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Seven numbers a line, `?` for null; lines with another number of tokens are left out."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    return lines.select(*keep, parts.alias("p")).where(F.size("p") == len(GRID)).select(*keep, *[number_or_null(F.col("p")[i]).alias(n) for i, n in enumerate(GRID)])


def read_grids(spark: SparkSession, path: str, glob: str = "*.grid") -> DataFrame:
    """The grids below path with the site's name, taken from the file's."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob)
    return parse_grid(lines.withColumn("site", F.regexp_extract("_metadata.file_name", r"^asci_grid_(.*)\.grid$", 1)), "value", ("site",))


def parse_surface(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select("*", *[key_value(F.col(text), label).alias(n) for n, label in SURFACE.items()])


def parse_volume(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select("*", *[key_value(F.col(text), label).alias(n) for n, label in VOLUME.items()])


def parse_pores(texts: DataFrame, text: str = "text") -> DataFrame:
    """The three sphere diameters that follow the file's name."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    return texts.select("*", *[number_or_null(F.try_element_at(parts, F.lit(i + 2))).alias(n) for i, n in enumerate(POSITIONAL)])


def parse_histogram_lines(texts: DataFrame, key: str, text: str = "text", skip: int = 1) -> DataFrame:
    """(key, bin, value): a number a line after the head."""
    lines = texts.select(key, F.posexplode(F.split(F.trim(F.col(text)), "\n")).alias("pos", "line"))
    return lines.where(F.col("pos") >= skip).select(key, (F.col("pos") - skip).alias("bin"), number_or_null(F.trim("line")).alias("value"))


def parse_pore_distribution(texts: DataFrame, key: str, text: str = "text", skip: int = 11) -> DataFrame:
    """(key, bin, d, count, cumulative, derivative) of a pore size distribution."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).where(F.col("pos") >= skip)
    parts = F.split(F.trim("line"), r"\s+")
    return lines.where(F.size(parts) == 4).select(key, (F.col("pos") - skip).alias("bin"), *[number_or_null(parts[i]).alias(n) for i, n in enumerate(("d", "count", "cumulative", "derivative"))])


def log_sections(texts: DataFrame, key: str, markers: dict[str, str], text: str = "text") -> DataFrame:
    """(key, pos, section, line): every line with the section that the last marker before it opened.

    The running section of a file's lines is a window over one file.
    """
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    opened = F.lit(None).cast("string")
    for name, pattern in markers.items():
        opened = F.when(F.col("line").rlike(pattern), name).otherwise(opened)
    over = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.select(key, "pos", F.last(opened, ignorenulls=True).over(over).alias("section"), "line")


def log_values(sections: DataFrame, key: str) -> DataFrame:
    """(key, section, name, value, unit) of lines like `Average name: value [unit]`."""
    pattern = r"^\s*(?:Average )?([A-Za-z][A-Za-z _()/-]*?):?\s+(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*(?:\[([^\]]*)\])?"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return sections.where(F.col("line").rlike(pattern)).select(key, "section", F.trim(part(1)).alias("name"), part(2).try_cast("double").alias("value"), F.when(part(3) != "", part(3)).alias("unit"))


def read_element_prices(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, name, abundance, price) of a price table in CSV with comment lines; footnote rows have no symbol and go."""
    raw = spark.read.option("header", True).option("comment", "#").option("multiLine", True).csv(path)
    names = raw.columns
    return raw.toDF(*[f"c{i}" for i in range(len(names))]).select(F.trim("c1").alias("symbol"), F.trim("c2").alias("name"), clean_abundance(F.col("c4")).alias("abundance"), clean_price(F.col("c5")).alias("price")).where(F.col("symbol").rlike("^[A-Z][a-z]?$"))


def widom(values: DataFrame, key: str) -> DataFrame:
    """(key, henry_coefficient, enthalpy of adsorption in kJ/mol) of parsed log values."""
    pick = lambda n: F.max(F.when(F.lower("name").contains(n), F.col("value")))
    return values.groupBy(key).agg(pick("henry coefficient").alias("henry_coefficient"), (pick("enthalpy of adsorption") * (8.314464919 / 1000)).alias("enthalpy_kj_mol"))
