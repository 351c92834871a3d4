"""Featurizers over tables of structures and sites: each gives one row a structure with an array, and its labels.

The labels follow from the parameters alone, so the width of an array is known before a row is read. Structures
without what a feature needs have nulls in its places.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.aggregators import AGGREGATORS, COMBINERS
from latticework.operators import graph, histogram, tiles, topology
from latticework.shared import written

# The groups of atom types that features are split by.
ATOM_TYPES = ("C-H-N-O", "F-Cl-Br-I", "Cu-Mn-Ni-Mo-Fe-Pt-Zn-Ca-Er-Au-Cd-Co-Gd-Na-Sm-Eu-Tb-V-Ag-Nd-U-Ba-Ce-K-Ga-Cr-Al-Li-Sc-Ru-In-Mg-Zr-Dy-W-Yb-Y-Ho-Re-Be-Rb-La-Sn-Cs-Pb-Pr-Bi-Tm-Sr-Ti-Hf-Ir-Nb-Pd-Hg-Th-Np-Lu-Rh-Pu")


@dataclass(frozen=True)
class Features:
    """(key, features array<double>) and the array's labels."""

    df: DataFrame
    labels: tuple[str, ...]
    key: str = "struct_id"

    def wide(self) -> DataFrame:
        return self.df.select(self.key, *[F.col("features")[i].alias(n) for i, n in enumerate(self.labels)])

    def long(self) -> DataFrame:
        return self.df.select(self.key, F.posexplode("features").alias("i", "value")).select(self.key, F.array(*[F.lit(n) for n in self.labels])[F.col("i")].alias("feature"), "value")


def arrays(long: DataFrame, ids: DataFrame, key: str, place: Column, value: str, width: int, fill: float | None) -> DataFrame:
    """(key, features) from (key, place, value) rows; places without a row are filled."""
    own = long.groupBy(F.col(key).alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("i"), F.col(value).cast("double").alias("v")))).alias("__m"))
    default = F.lit(fill).cast("double")
    met = ids.select(key).distinct().join(own, F.col(key) == F.col("__k"), "left")
    return met.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), default)).alias("features"))


def concatenated(*parts: Features) -> Features:
    """Several features of the same structures side by side: joins on the key, which share its partitioning."""
    key = parts[0].key
    named = [p.df.select(F.col(p.key).alias(key), F.col("features").alias(f"f{i}")) for i, p in enumerate(parts)]
    df = reduce(lambda a, b: a.join(b, key, "full"), named)
    filled = [F.coalesce(f"f{i}", F.array_repeat(F.lit(None).cast("double"), len(p.labels))) for i, p in enumerate(parts)]
    return Features(df.select(key, F.concat(*filled).alias("features")), tuple(n for p in parts for n in p.labels), key)


def applied(df: DataFrame, key: str, columns: list[str], f: Callable[..., list[float]], labels: tuple[str, ...]) -> Features:
    """A callable on the columns of each row, in Arrow batches. A row on which it fails has nulls and its message in _error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for k, *values in zip(d[key], *(d[c] for c in columns)):
                try:
                    rows.append((k, [float(x) for x in f(*values)], ""))
                except Exception as e:  # a user's function may raise anything; the row says what
                    rows.append((k, [np.nan] * len(labels), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "features", "_error"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, *columns).mapInPandas(run, f"{key} {kind}, features array<double>, _error string")
    clean = F.transform("features", lambda x: F.when(~F.isnan(x), x))
    return Features(out.select(key, clean.alias("features"), F.when(F.col("_error") != "", F.col("_error")).alias("_error")), labels, key)


def of_type(symbol: Column, group: str) -> Column:
    return symbol.isin(*group.split("-"))


def type_names(types: tuple[str, ...], every: bool) -> list[str]:
    return [*types, *(["all"] if every else [])]


def by_type(sites: DataFrame, types: tuple[str, ...], every: bool) -> DataFrame:
    """sites once for each group of atom types that it belongs to, numbered in `type`."""
    where = [F.when(of_type(F.col("symbol"), g), F.lit(i)) for i, g in enumerate(types)] + ([F.lit(len(types))] if every else [])
    return sites.withColumn("type", F.explode(F.array_compact(F.array(*where))))


def _weighted(structures: DataFrame, sites: DataFrame, key: str, properties: DataFrame, names: tuple[str, ...], combiners: tuple[str, ...], cutoff: float, lower: float, width: float, smear: float, role: tuple[Column, Column] | None = None) -> Features:
    """Each tile of a structure's pairs leaves one sum for each property, combiner and bin; no pair becomes a row."""
    n = int((cutoff - lower) // width)
    step = (cutoff - lower) / (n - 1)
    values = F.broadcast(properties.select(F.col("symbol").alias("__y"), *[F.col(p).cast("double").alias(f"__p{i}") for i, p in enumerate(names)]))
    cell = structures.select(F.col("struct_id").alias("__s"), F.flatten("lattice").alias("__c"))
    own = sites.join(values, F.col("symbol") == F.col("__y")).join(cell, F.col("struct_id") == F.col("__s")).withColumn("__x", F.concat(F.array("fx", "fy", "fz"), "__c"))
    within, of = role is None, [f"__p{i}" for i in range(len(names))]
    # The lower limit is a step too.
    limits, steps = tiles.near_limits(cutoff), tiles.near_steps(lower, width)

    def fold(a: tiles.Block, b: tiles.Block, same: bool) -> dict:
        sums, count = np.zeros((len(names) * len(combiners), n)), np.zeros(n, np.int64)
        for i, j, d, mask in tiles.chunks(a, b, same, tiles.measured_images, lambda d: limits(d) | steps(d)):
            inside = (d < cutoff) & (d > lower)
            if mask is not None:
                inside &= mask
            if not inside.any():
                continue
            d = d[inside]
            # The bin has the given width; its centre is of an even spacing from end to end, which is a little wider.
            slot = np.minimum(((d - lower) / width).astype(np.int64), n - 1)
            count += np.bincount(slot, minlength=n)
            d -= lower + slot * step
            weight = np.exp(-smear * d * d)
            for y, (p, c) in enumerate((p, c) for p in of for c in combiners):
                x = tiles.combined(c, a, b, i, j, (p, p), within)[inside]
                sums[y] += np.bincount(slot, weights=np.where(np.isnan(x), 0.0, x) * weight, minlength=n)
        slots = np.flatnonzero(count)
        rows = np.arange(len(sums))
        return {"row": np.repeat(rows, len(slots)), "slot": np.tile(slots, len(rows)), "v": sums[:, slots].ravel()} if len(slots) else {}

    met = tiles.tiles(own, "struct_id", key, "__x", fold, "row int, slot int, v double", role=role, columns=tuple(of))
    long = met.groupBy("struct_id", "slot", "row").agg(F.sum("v").alias("v"))
    labels = tuple(f"aprdf_{p}_{c}_{i}" for p in names for c in combiners for i in range(n))
    return Features(arrays(long, structures, "struct_id", F.col("row") * n + F.col("slot"), "v", len(labels), 0.0), labels)


def aprdf(structures: DataFrame, sites: DataFrame, properties: DataFrame, names: tuple[str, ...], combiners: tuple[str, ...] = ("avg", "product", "diff"), cutoff: float = 20.0, lower: float = 2.0, width: float = 0.25, smear: float = 10.0) -> Features:
    """Radial distribution functions of site pairs, by the nearest image, weighted by combined properties; a pair counts in its own bin."""
    return _weighted(structures, sites, "site_id", properties, names, combiners, cutoff, lower, width, smear)


def guest_aprdf(structures: DataFrame, roles: DataFrame, properties: DataFrame, names: tuple[str, ...], combiners: tuple[str, ...] = ("avg", "product", "diff"), cutoff: float = 20.0, lower: float = 2.0, width: float = 0.25, smear: float = 10.0) -> Features:
    """The same over pairs of a guest's and a host's site. roles: sites with `role`, host or guest."""
    own = roles.withColumn("__at", F.xxhash64("symbol", "fx", "fy", "fz"))
    return _weighted(structures, own, "__at", properties, names, combiners, cutoff, lower, width, smear, (F.col("role") == "guest", F.col("role") == "host"))


def amd(structures: DataFrame, sites: DataFrame, k: int = 100, types: tuple[str, ...] = ATOM_TYPES, every: bool = True, names: tuple[str, ...] = ("mean",), reach: float = 30.0) -> Features:
    """Aggregates over sites of the distance to the j-th neighbour among periodic images, for each group of atom types.

    Images up to `reach` away are searched first. A structure's type in which a site has fewer than k of them is searched again
    up to a radius that holds k for certain, so that reach changes the work and not the result. A type that a structure lacks has nulls.
    """
    own = by_type(sites, types, every)
    v = [[F.col("lattice")[r][c] for c in range(3)] for r in range(3)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: sum((x * y for x, y in zip(p, q)), F.lit(0.0))
    normal = [cross(v[1], v[2]), cross(v[2], v[0]), cross(v[0], v[1])]
    volume = F.nullif(F.abs(dot(v[0], normal[0])), F.lit(0.0))
    # A ball holds a whole cell, with an image of each site, for each cell that meets the ball less by a cell's diagonal.
    sure = sum((F.sqrt(dot(r, r)) for r in v), F.lit(0.0)) + F.pow(volume * (3.0 * (k + 1) / (4 * math.pi)) / F.col("m"), F.lit(1 / 3))
    placed = own.join(structures.select(F.col("struct_id").alias("ls"), "lattice"), F.col("struct_id") == F.col("ls"))
    # Along each axis: the perpendicular width, and how far apart the sites stand in cells.
    at = [dot([F.col(c) for c in "xyz"], n) / volume for n in normal]
    cells = placed.groupBy(F.col("struct_id").alias("cs"), F.col("type").alias("ct")).agg(F.first("lattice").alias("lattice"), F.count("*").alias("m"), F.array(*[F.max(f) - F.min(f) for f in at]).alias("spread"))
    cells = cells.select("cs", "ct", "lattice", "m", "spread", F.array(*[volume / F.sqrt(dot(n, n)) for n in normal]).alias("width"), sure.alias("sure"))

    def nearest(cells: DataFrame) -> DataFrame:
        """(struct_id, type, site_id, d, m): the k smallest distances up to `far`."""
        mine = own.join(cells, (F.col("struct_id") == F.col("cs")) & (F.col("type") == F.col("ct")))
        image = mine
        for r, n in enumerate("ijk"):
            most = F.ceil(F.col("far") / F.col("width")[r] + F.col("spread")[r] + 1e-9).cast("int")
            image = image.withColumn(n, F.explode(F.sequence(-most, most)))
        moved = [(F.col(c) + sum((F.col(n) * F.col("lattice")[r][x] for r, n in enumerate("ijk")), F.lit(0.0))).alias(f"{c}2") for x, c in enumerate("xyz")]
        image = image.select(F.col("struct_id").alias("s2"), F.col("type").alias("t2"), F.col("site_id").alias("i2"), "i", "j", "k", *moved)
        met = mine.join(image, (F.col("struct_id") == F.col("s2")) & (F.col("type") == F.col("t2"))).where("site_id <> i2 or i <> 0 or j <> 0 or k <> 0")
        d = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0)))
        near = met.select("struct_id", "type", "site_id", "m", "far", d.alias("d")).where("d <= far")
        return near.groupBy("struct_id", "type", "site_id", "m").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("d"))

    first = written(nearest(cells.withColumn("far", F.lit(float(reach)))), "near")
    full = first.where(F.size("d") == k).groupBy(F.col("struct_id").alias("fs"), F.col("type").alias("ft"), "m").agg(F.count("*").alias("n")).where("n = m").select("fs", "ft")
    of_full = lambda s, t: (F.col(s) == F.col("fs")) & (F.col(t) == F.col("ft"))
    again = nearest(cells.join(full, of_full("cs", "ct"), "left_anti").withColumn("far", F.col("sure")))
    ranked = first.join(full, of_full("struct_id", "type"), "left_semi").union(again).select("struct_id", "type", F.posexplode("d").alias("rank", "d"))
    each = ranked.groupBy("struct_id", "type", "rank").agg(*[AGGREGATORS[a](F.col("d")).alias(a) for a in names])
    long = each.select("struct_id", "type", "rank", F.posexplode(F.array(*[F.col(a).cast("double") for a in names])).alias("a", "v"))
    kinds = type_names(types, every)
    labels = tuple(f"amd_{t}_{a}_{i}" for t in kinds for a in names for i in range(k))
    return Features(arrays(long, structures, "struct_id", (F.col("type") * len(names) + F.col("a")) * k + F.col("rank"), "v", len(labels), None), labels)


def racs(sites: DataFrame, bonds: DataFrame, blocks: DataFrame, properties: DataFrame, names: tuple[str, ...] = ("X", "mod_pettifor", "I", "T"), scopes: tuple[int, ...] = (1, 2, 3), combiners: tuple[str, ...] = ("product", "diff"), over_pairs: tuple[str, ...] = ("sum", "avg"), over_blocks: tuple[str, ...] = ("avg", "sum"), roles: tuple[str, ...] = ("linker_all", "linker_connecting", "linker_functional", "linker_scaffold", "nodes")) -> Features:
    """Revised autocorrelations: properties of the ends of walks of `scope` bonds, combined, aggregated in blocks and over them.

    I is 1 everywhere; T is the number of a start's walk ends, and for an end the number of its neighbours. blocks: (struct_id, role, frag_id, site_ids).
    """
    start = blocks.select("struct_id", "role", "frag_id", F.explode("site_ids").alias("start"))
    degree = graph.degrees(bonds, ["struct_id"]).select(F.col("struct_id").alias("ds"), F.col("i").alias("di"), F.col("degree").cast("double").alias("degree"))
    real = [p for p in names if p not in ("I", "T")]
    values = sites.select("struct_id", "site_id", "symbol").join(F.broadcast(properties), "symbol").select(F.col("struct_id").alias("vs"), F.col("site_id").alias("vi"), *[F.col(p).cast("double").alias(p) for p in real])
    parts = []
    for scope in scopes:
        ends = graph.walk_ends(bonds, scope, ["struct_id"]).select(F.col("struct_id").alias("es"), F.col("start").alias("e0"), "end")
        count = ends.groupBy("es", "e0").agg(F.count("*").cast("double").alias("many")).select(F.col("es").alias("cs"), F.col("e0").alias("c0"), "many")
        met = start.join(ends, (F.col("struct_id") == F.col("es")) & (F.col("start") == F.col("e0"))).join(count, (F.col("es") == F.col("cs")) & (F.col("e0") == F.col("c0"))).join(degree, (F.col("es") == F.col("ds")) & (F.col("end") == F.col("di")))
        a, b = (values.select(*[F.col(c).alias(f"{s}_{c}") for c in values.columns]) for s in "ab")
        met = met.join(a, (F.col("es") == F.col("a_vs")) & (F.col("e0") == F.col("a_vi"))).join(b, (F.col("es") == F.col("b_vs")) & (F.col("end") == F.col("b_vi")))
        ends_of = {p: (F.col(f"a_{p}"), F.col(f"b_{p}")) for p in real} | {"I": (F.lit(1.0), F.lit(1.0)), "T": (F.col("many"), F.col("degree"))}
        spread = F.explode(F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(c).alias("combiner"), COMBINERS[c](*ends_of[p]).alias("v")) for p in names for c in combiners])).alias("x")
        parts.append(met.select("struct_id", "role", "frag_id", F.lit(scope).alias("scope"), spread).select("struct_id", "role", "frag_id", "scope", "x.prop", "x.combiner", "x.v"))
    long = reduce(DataFrame.union, parts)
    inner = long.groupBy("struct_id", "role", "frag_id", "scope", "prop", "combiner").agg(*[AGGREGATORS[n](F.col("v")).cast("double").alias(n) for n in over_pairs])
    inner = inner.select("struct_id", "role", "scope", "prop", "combiner", F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(f"`{n}`").alias("v")) for n in over_pairs])).alias("x"))
    outer = inner.groupBy("struct_id", "role", "scope", "prop", "combiner", "x.pair").agg(*[AGGREGATORS[n](F.col("x.v")).cast("double").alias(n) for n in over_blocks])
    named = outer.select("struct_id", F.explode(F.array(*[F.struct(F.concat_ws("_", F.lit("racs"), "role", "prop", F.concat(F.lit("scope-"), "scope"), F.concat(F.lit("propagg-"), "combiner"), F.concat(F.lit("corragg-"), "pair"), F.lit(f"bbagg-{n}")).alias("label"), F.col(f"`{n}`").alias("v")) for n in over_blocks])).alias("x"))
    labels = tuple(sorted(f"racs_{r}_{p}_scope-{s}_propagg-{c}_corragg-{a}_bbagg-{b}" for r in roles for p in names for s in scopes for c in combiners for a in over_pairs for b in over_blocks))
    place = F.create_map(*[x for i, n in enumerate(labels) for x in (F.lit(n), F.lit(i))])[F.col("x.label")]
    own = named.select("struct_id", place.alias("place"), F.col("x.v").alias("v")).where("place is not null")
    return Features(arrays(own, sites, "struct_id", F.col("place"), "v", len(labels), None), labels)


def charge_histogram(sites: DataFrame, low: float = -4, high: float = 4, width: float = 0.5) -> Features:
    n = histogram.bin_count(low, high, width)
    own = histogram.histogram(sites, ["struct_id"], "charge", low, high, width, density=True)
    labels = tuple(f"chargehist_{low + i * width:g}" for i in range(n))
    return Features(arrays(own, sites, "struct_id", F.col("bin"), "n", n, 0.0), labels)


def column_stats(rows: DataFrame, key: str, column: str, names: tuple[str, ...], label: str) -> Features:
    df = rows.groupBy(key).agg(F.array(*[AGGREGATORS[n](F.col(column).cast("double")).cast("double") for n in names]).alias("features"))
    return Features(df, tuple(f"{label}_{n}" for n in names), key)


def charge_stats(sites: DataFrame, names: tuple[str, ...] = ("max", "min", "std")) -> Features:
    return column_stats(sites, "struct_id", "charge", names, "charge")


def energy_histogram(grids: DataFrame, low: float = -40, high: float = 0, width: float = 1.0, kinds: tuple[str, ...] = ("C_co2",)) -> Features:
    """grids: (struct_id, site, energy)."""
    n = histogram.bin_count(low, high, width)
    own = histogram.histogram(grids, ["struct_id", "site"], "energy", low, high, width, density=True)
    place = F.create_map(*[x for i, s in enumerate(kinds) for x in (F.lit(s), F.lit(i))])[F.col("site")]
    own = own.where(F.col("site").isin(*kinds))
    labels = tuple(f"energygrid_{s}_{low + i * width:g}" for s in kinds for i in range(n))
    return Features(arrays(own, grids, "struct_id", place * n + F.col("bin"), "n", len(labels), 0.0), labels)


def distance_stats(pairs: DataFrame, names: tuple[str, ...] = ("mean", "std", "max", "min")) -> Features:
    return column_stats(pairs, "struct_id", "distance", names, "pairwise_distance_stats")


def distance_histogram(pairs: DataFrame, low: float = 0.0, high: float = 15.0, width: float = 0.5) -> Features:
    n = histogram.bin_count(low, high, width)
    own = histogram.histogram(pairs, ["struct_id"], "distance", low, high, width, density=True)
    return Features(arrays(own, pairs, "struct_id", F.col("bin"), "n", n, 0.0), tuple(f"pairwise_distance_hist_{low + i * width:g}" for i in range(n)))


def diagram_features(diagrams: DataFrame, kinds: tuple[str, ...], dims: tuple[int, ...] = (1, 2), names: tuple[str, ...] = ("min", "max", "mean", "std")) -> Features:
    """diagrams: (struct_id, atom_type, dim, birth, death). What a structure lacks is 0."""
    own = topology.diagram_stats(diagrams, ["struct_id", "atom_type", "dim"], names)
    labels = tuple(f"phstats_{t}_dim{d}_{q}_{n}" for t in kinds for d in dims for q in ("persistence", "death", "birth") for n in names)
    long = own.select("struct_id", F.explode(F.array(*[F.struct(F.concat_ws("_", F.lit("phstats"), "atom_type", F.concat(F.lit("dim"), "dim"), "quantity", F.lit(n)).alias("label"), F.col(n).alias("v")) for n in names])).alias("x"))
    place = F.create_map(*[x for i, n in enumerate(labels) for x in (F.lit(n), F.lit(i))])[F.col("x.label")]
    return Features(arrays(long.select("struct_id", place.alias("place"), F.col("x.v").alias("v")).where("place is not null"), diagrams, "struct_id", F.col("place"), "v", len(labels), 0.0), labels)


def over_roles(features: Features, owners: DataFrame, roles: tuple[str, ...] = ("node", "linker"), names: tuple[str, ...] = ("mean", "std", "min", "max")) -> Features:
    """Features of fragments aggregated for each structure and role. owners: (frag_id, struct_id, role); features keyed by frag_id."""
    long = features.df.select(F.col(features.key).alias("frag"), F.posexplode("features").alias("i", "v")).join(owners.select(F.col("frag_id"), "struct_id", "role"), F.col("frag") == F.col("frag_id"))
    each = long.groupBy("struct_id", "role", "i").agg(*[AGGREGATORS[n](F.col("v")).cast("double").alias(n) for n in names])
    spread = each.select("struct_id", "role", "i", F.posexplode(F.array(*[F.col(n) for n in names])).alias("a", "v"))
    place = F.create_map(*[x for i, r in enumerate(roles) for x in (F.lit(r), F.lit(i))])[F.col("role")]
    width = len(features.labels)
    labels = tuple(f"{r}_{n}_{label}" for r in roles for n in names for label in features.labels)
    own = spread.where(F.col("role").isin(*roles))
    return Features(arrays(own, owners, "struct_id", (place * len(names) + F.col("a")) * width + F.col("i"), "v", len(labels), None), labels)
