"""Molecule tables: charges and metals, pattern counts, conformer counts, order parameters about a centre, and prose."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.featurizers import Features, applied

ORDER_PARAMETERS = ("cn", "sgl_bd", "bent180", "q2", "q4", "q6")


def without_metals(sites: DataFrame, bonds: DataFrame, metals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sites, bonds) without metal sites and what is bound to them. metals: (symbol)."""
    own = sites.join(F.broadcast(metals.select("symbol")), "symbol", "left_anti")
    gone = sites.join(F.broadcast(metals.select("symbol")), "symbol", "left_semi").select(F.col("struct_id").alias("gs"), F.col("site_id").alias("gi"))
    left = bonds
    for c in ("i", "j"):
        left = left.join(gone, (F.col("struct_id") == F.col("gs")) & (F.col(c) == F.col("gi")), "left_anti")
    return own, left


def formal_charges(sites: DataFrame, bonds: DataFrame, metal_charges: DataFrame, valence: DataFrame) -> DataFrame:
    """(struct_id, site_id, charge): a metal's usual charge; else how many bonds a site has beyond its valence. Both tables are of elements."""
    degree = bonds.groupBy(F.col("struct_id").alias("ds"), F.col("i").alias("di")).agg(F.count("*").alias("degree"))
    met = sites.join(degree, (F.col("struct_id") == F.col("ds")) & (F.col("site_id") == F.col("di")), "left")
    met = met.join(F.broadcast(metal_charges.select(F.col("symbol").alias("ms"), F.col("charge").alias("mc"))), F.col("symbol") == F.col("ms"), "left")
    met = met.join(F.broadcast(valence.select(F.col("symbol").alias("vs"), "valence")), F.col("symbol") == F.col("vs"), "left")
    return met.select("struct_id", "site_id", F.coalesce("mc", F.coalesce("degree", F.lit(0)) - F.col("valence"), F.lit(0)).cast("int").alias("charge"))


def pattern_counts(texts: DataFrame, key: str, text: str, patterns: tuple[str, ...]) -> DataFrame:
    """(key, n): matches of any of the patterns, regular expressions over a linear notation, without overlap."""
    return texts.select(key, F.regexp_count(F.col(text), F.lit("|".join(f"(?:{p})" for p in patterns))).alias("n"))


def conformers_within(energies: DataFrame, key: str, energy: str, window: float = 20.0) -> DataFrame:
    """(key, n): conformers less than `window` above the lowest, which isn't counted. Energies are of distinct conformers."""
    low = energies.groupBy(F.col(key).alias("__k")).agg(F.min(energy).alias("__low"))
    met = energies.join(low, F.col(key) == F.col("__k"))
    return met.groupBy(key).agg((F.sum((F.col(energy) - F.col("__low") < window).cast("int")) - 1).alias("n"))


def order_parameters(points: list, masses: list) -> list[float]:
    """The number of sites, the bend to 180 degrees and bond-orientation parameters of the directions from the centre of mass."""
    p, m = np.array([list(x) for x in points], float), np.array(list(masses), float)
    v = p - (m[:, None] * p).sum(axis=0) / m.sum()
    r = np.linalg.norm(v, axis=1)
    u = v[r > 1e-9] / r[r > 1e-9][:, None]
    cos = np.clip(u @ u.T, -1, 1)
    legendre = {2: (3 * cos**2 - 1) / 2, 4: (35 * cos**4 - 30 * cos**2 + 3) / 8, 6: (231 * cos**6 - 315 * cos**4 + 105 * cos**2 - 5) / 16}
    bend = float(np.exp(-(((np.pi - np.arccos(cos[np.triu_indices(len(u), 1)])) / np.radians(12)) ** 2) / 2).max()) if len(u) > 1 else float("nan")
    q = [float(np.sqrt(max(0.0, legendre[n].mean()))) if len(u) else float("nan") for n in (2, 4, 6)]
    return [float(len(p)), float(len(p) == 1), bend, *q]


def local_order(blocks: DataFrame, key: str, xyz: str = "xyz", mass: str = "mass") -> Features:
    """Order parameters of each block's sites about its centre of mass."""
    return applied(blocks, key, [xyz, mass], order_parameters, tuple(f"lsop_{n}" for n in ORDER_PARAMETERS))


def described(structures: DataFrame, key: str, fragments: DataFrame | None = None, numbers: dict[str, str] | None = None, text: str | None = None) -> DataFrame:
    """(key, description): condensed text if there is some, the counts of fragments (key, role, smiles), and formatted numbers by their phrase."""
    own = structures.select(key, *([F.col(text).alias("__t")] if text else [F.lit("").alias("__t")]), *[F.format_string(f"{phrase} %.2f.", F.col(c).cast("double")).alias(f"__n{i}") for i, (c, phrase) in enumerate((numbers or {}).items())])
    parts = [F.col("__t")]
    if fragments is not None:
        count = fragments.groupBy(F.col(key).alias("__k"), "role", "smiles").agg(F.count("*").alias("n"))
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "smiles", "n"))), lambda s: F.format_string("%d %s %s", s.getField("n"), s.getField("role"), s.getField("smiles"))), ", ")
        own = own.join(count.groupBy("__k").agg(F.concat(F.lit("It has "), said, F.lit(".")).alias("__f")), F.col(key) == F.col("__k"), "left")
        parts.append(F.col("__f"))
    parts += [F.col(f"__n{i}") for i in range(len(numbers or {}))]
    return own.select(key, F.trim(F.concat_ws(" ", *parts)).alias("description"))
