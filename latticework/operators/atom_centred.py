"""Persistence about every site: diagrams of a site's surroundings, their statistics, and these by species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import groupwise, topology
from latticework.operators.pairs import radius_neighbours


def surroundings(structures: DataFrame, sites: DataFrame, cutoff: float) -> DataFrame:
    """(struct_id, site_id, x, y, z): each site with the periodic images within the cutoff of it."""
    near = radius_neighbours(structures, sites, cutoff).select("struct_id", "site_id", "other", "i", "j", "k")
    lattice = structures.select(F.col("struct_id").alias("ls"), "lattice")
    own = sites.select(F.col("struct_id").alias("os"), F.col("site_id").alias("oi"), "x", "y", "z")
    met = near.join(own, (F.col("struct_id") == F.col("os")) & (F.col("other") == F.col("oi"))).join(lattice, F.col("struct_id") == F.col("ls"))
    moved = [(F.col(c) + sum((F.col(n) * F.col("lattice")[r][x] for r, n in enumerate("ijk")), F.lit(0.0))).alias(c) for x, c in enumerate("xyz")]
    return met.select("struct_id", "site_id", *moved).union(sites.select("struct_id", "site_id", "x", "y", "z"))


def atom_centred_stats(structures: DataFrame, sites: DataFrame, species: tuple[str, ...], cutoff: float = 12.0, names: tuple[str, ...] = ("min", "max", "mean", "std"), over: tuple[str, ...] = ("mean", "max")) -> DataFrame:
    """(struct_id, symbol or 'all', quantity, feature, one column for each of `over`): statistics of the diagrams about each site, aggregated over the sites of a species and over all.

    A species that a structure lacks has zeros. structures: (struct_id, lattice); sites: (struct_id, site_id, symbol, x, y, z). The surroundings of a site must fit a task.
    """
    around = surroundings(structures, sites, cutoff).withColumn("about", F.concat_ws("#", "struct_id", "site_id"))
    stats = topology.diagram_stats(topology.h0_diagrams(around, "about"), ["about"], names)
    long = stats.select("about", "quantity", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])).alias("f")).select("about", "quantity", "f.feature", "f.value")
    own = sites.select(F.concat_ws("#", "struct_id", "site_id").alias("__a"), "struct_id", "symbol")
    met = long.join(own, F.col("about") == F.col("__a"))
    return groupwise.by_species_and_all(met, ["struct_id", "quantity", "feature"], "symbol", "value", over, species)
