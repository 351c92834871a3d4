"""Pairs of points: theta joins within a group, neighbours, weighted histograms of pairs, lattice images."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators import tiles
from latticework.operators.histogram import bin_count


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """The distance of two arrays of doubles."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    by = lambda f: F.zip_with(a, b, f)
    if metric == "euclidean":
        return F.sqrt(total(by(lambda x, y: (x - y) * (x - y))))
    if metric == "cityblock":
        return total(by(lambda x, y: F.abs(x - y)))
    if metric == "chebyshev":
        return F.array_max(by(lambda x, y: F.abs(x - y)))
    if metric == "cosine":
        norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
        return 1 - total(by(lambda x, y: x * y)) / (norm(a) * norm(b))
    if metric == "sqeuclidean":
        return total(by(lambda x, y: (x - y) * (x - y)))
    if metric == "braycurtis":
        return total(by(lambda x, y: F.abs(x - y))) / total(by(lambda x, y: F.abs(x + y)))
    if metric == "canberra":
        return total(by(lambda x, y: F.when((x != 0) | (y != 0), F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)))
    if metric == "hamming":
        return total(by(lambda x, y: (x != y).cast("double"))) / F.size(a)
    if metric == "correlation":
        less = lambda x: F.transform(x, lambda v: v - total(x) / F.size(x))
        return distance(less(a), less(b), "cosine")
    raise ValueError(f"unknown metric {metric}")


def pairs_within(df: DataFrame, group: str, key: str, *columns: str, role: tuple[Column, Column] | None = None, blocks: int = 4) -> DataFrame:
    """Each two rows of a group once (key a < key b), with columns suffixed _a and _b.

    The join is an equi-join on group and on the blocks that both rows are dealt to by their keys: a group's pairs are the work of blocks * blocks
    keys, and so of many tasks, for which a row is sent `blocks` times. With role = (left filter, right filter) it is every left row with every right one.
    """
    own = lambda s: F.pmod(F.xxhash64(F.col(f"{key}_{s}")), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def side(s: str, where: Column | None) -> DataFrame:
        rows = (df.where(where) if where is not None else df).select(F.col(group).alias(f"__{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (key, *columns)])
        return rows.withColumn(f"__{s}x", own(s) if s == "a" else every).withColumn(f"__{s}y", every if s == "a" else own(s))

    left, right = side("a", role[0] if role else None), side("b", role[1] if role else None)
    on = (F.col("__a") == F.col("__b")) & (F.col("__ax") == F.col("__bx")) & (F.col("__ay") == F.col("__by"))
    if role is None:
        on &= F.col(f"{key}_a") < F.col(f"{key}_b")
    return left.join(right, on).drop("__b", "__ax", "__ay", "__bx", "__by").withColumnRenamed("__a", group)


def pairs_within_cutoff(points: DataFrame, group: str, key: str, cutoff: float, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of a group up to a distance, through cells of the cutoff's size: an equi-join on (group, cell)."""
    cells = F.struct(*[F.floor(F.col(c) / cutoff).alias(c) for c in xyz])
    own = points.select(F.col(group).alias("g"), F.col(key).alias("k"), *xyz, cells.alias("cell"))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = own
    for c in xyz:
        near = near.withColumn(f"d{c}", F.explode(step))
    near = near.select(F.col("g").alias("g2"), F.col("k").alias("k2"), *[F.col(c).alias(f"{c}2") for c in xyz], F.struct(*[(F.col("cell").getField(c) + F.col(f"d{c}")).alias(c) for c in xyz]).alias("cell2"))
    met = own.join(near, (F.col("g") == F.col("g2")) & (F.col("cell") == F.col("cell2")) & (F.col("k") < F.col("k2")))
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in xyz), F.lit(0.0)))
    return met.withColumn("distance", d).where(F.col("distance") <= cutoff).select(F.col("g").alias(group), F.col("k").alias(f"{key}_a"), F.col("k2").alias(f"{key}_b"), "distance")


def minimum_image(lattice: Column, fa: Column, fb: Column) -> Column:
    """The smallest distance of two fractional positions over the 27 neighbouring images of a lattice of three row vectors."""
    images = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.array(i, j, k))))))

    def length(image: Column) -> Column:
        frac = [fb[c] - fa[c] + image[c] for c in range(3)]
        cart = [sum((frac[r] * lattice[r][c] for r in range(3)), F.lit(0.0)) for c in range(3)]
        return F.sqrt(sum((x * x for x in cart), F.lit(0.0)))

    return F.array_min(F.transform(images, length))


def lattice_vectors(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Three row vectors from cell lengths and angles in degrees, the first along x."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    return F.array(F.array(a, F.lit(0.0), F.lit(0.0)), F.array(b * cg, b * sg, F.lit(0.0)), F.array(cx, cy, F.sqrt(c * c - cx * cx - cy * cy)))


def replicas(lattice: Column, threshold: float) -> Column:
    """How often a cell repeats along each axis so that its perpendicular widths reach the threshold."""
    v = [[lattice[i][j] for j in range(3)] for i in range(3)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    size = lambda p: F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    normal = [cross(v[1], v[2]), cross(v[2], v[0]), cross(v[0], v[1])]
    volume = F.abs(sum((v[0][i] * normal[0][i] for i in range(3)), F.lit(0.0)))
    return F.array(*[F.ceil(F.lit(threshold) / (volume / size(n))).cast("int") for n in normal])


def supercell(points: DataFrame, lattice: tuple[tuple[float, ...], ...], box: float, xyz: tuple[str, ...] = ("x", "y", "z"), reach: tuple[int, int] = (-3, 20)) -> DataFrame:
    """Every lattice image of the points that falls into the box [0, box] on each axis; image numbers as i, j, k."""
    out = points
    for name in ("i", "j", "k"):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(reach[0]), F.lit(reach[1]))))
    moved = [(F.col(c) + sum((F.col(n) * lattice[r][at] for r, n in enumerate("ijk")), F.lit(0.0))).alias(f"{c}_moved") for at, c in enumerate(xyz)]
    out = out.select("*", *moved)
    for c in xyz:
        out = out.where((F.col(f"{c}_moved") >= 0) & (F.col(f"{c}_moved") <= box))
    return out


def nearest_neighbours(points: DataFrame, group: str, key: str, vector: str, k: int) -> DataFrame:
    """(group, key, rank, distance): the k smallest distances of each row to others of its group, ranked from 1; NaN comes after numbers, null after NaN.

    A tile leaves k distances a row, and those of a row's tiles meet.
    """

    def nearest(a: tiles.Block, b: tiles.Block, same: bool) -> tuple[pa.Array, list]:
        best, real = np.full((len(a), k), np.nan), np.zeros(len(a), np.int64)
        for i, j, m in tiles.measured(a, b):
            for r in range(0, len(i), tiles.ROWS):
                rows = slice(r, min(r + tiles.ROWS, len(i)))
                found = [best[i[rows]]]
                for c in range(0, len(j), tiles.COLUMNS):
                    cols = slice(c, min(c + tiles.COLUMNS, len(j)))
                    d, own = m.between(rows, cols, None), 0
                    if same:
                        equal = a.code[i[rows]][:, None] == b.code[j[cols]][None, :]
                        d[equal], own = np.nan, equal.sum(axis=1)
                    real[i[rows]] += cols.stop - cols.start - own
                    found.append(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k])
                best[i[rows]] = np.sort(np.hstack(found), axis=1)[:, :k]
        _, at, copies = np.unique(a.code, return_inverse=True, return_counts=True)
        every = len(b) - copies[at] if same else np.full(len(a), len(b))
        # The places of rows of the same key are NaN and last, so that the first of as many as are real are right.
        return a.keys, [x[: min(k, n)].tolist() + [None] * (min(k, m) - min(k, n)) for x, n, m in zip(best, real, every)]

    def fold(a: tiles.Block, b: tiles.Block, same: bool) -> dict:
        sides = [nearest(a, b, True)] if same else [nearest(a, b, False), nearest(b, a, False)]
        return {key: pa.concat_arrays([s[0] for s in sides]), "near": [x for s in sides for x in s[1]]}

    met = tiles.tiles(points, group, key, vector, fold, f"`{key}` KEY, near array<double>")
    best = met.groupBy(group, key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select(group, key, F.posexplode("near").alias("rank", "distance")).withColumn("rank", F.col("rank") + 1)


def average_minimum_distances(points: DataFrame, group: str, key: str, vector: str, k: int) -> DataFrame:
    """The mean over a group's rows of the distance to the j-th neighbour, for j from 1 to k."""
    return nearest_neighbours(points, group, key, vector, k).groupBy(group, "rank").agg(F.avg("distance").alias("mean_distance"))


def pair_histogram(points: DataFrame, group: str, key: str, vector: str, low: float, high: float, width: float) -> DataFrame:
    """(group, bin, n): the pairs of each group by their distance on a dense grid from low up to high, high left out. A group without pairs has no row."""
    bins = bin_count(low, high, width)

    def fold(a: tiles.Block, b: tiles.Block, same: bool) -> dict:
        n = np.zeros(bins, np.int64)
        for _, _, d, mask in tiles.chunks(a, b, same, near=tiles.near_steps(low, width)):
            d = d.ravel() if mask is None else d[mask]
            d = d[(d >= low) & (d < high)]
            n += np.bincount(np.minimum(((d - low) / width).astype(np.int64), bins - 1), minlength=bins)
        return {"n": [n.tolist()]} if tiles.pairs_of(a, b, same) else {}

    met = tiles.tiles(points, group, key, vector, fold, "n array<long>")
    return met.select(group, F.posexplode("n").alias("bin", "n")).groupBy(group, F.col("bin").cast("long").alias("bin")).agg(F.sum("n").alias("n"))


def pair_statistics(points: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, mean, std, max, min) of the distances of each group's pairs; those that are null or NaN don't count. A group without pairs has no row.

    Deviations are from the mean of a part, and parts are put together by theirs, so that a small spread about a large mean keeps its digits.
    """

    def fold(a: tiles.Block, b: tiles.Block, same: bool) -> dict:
        n, mean, spread, most, least = 0, 0.0, 0.0, -math.inf, math.inf
        for _, _, d, mask in tiles.chunks(a, b, same):
            d = d.ravel() if mask is None else d[mask]
            total = d.sum()
            if math.isnan(total):
                d = d[~np.isnan(d)]
                total = d.sum()
            if not len(d):
                continue
            most, least, m = max(most, float(d.max())), min(least, float(d.min())), float(total) / len(d)
            d -= m
            gap, both = m - mean, n + len(d)
            spread += float(np.dot(d, d)) + gap * gap * n * len(d) / both
            mean, n = mean + gap * len(d) / both, both
        if not tiles.pairs_of(a, b, same):
            return {}
        return {"n": [n], "mean": [mean], "spread": [spread], "max": [most if n else None], "min": [least if n else None]}

    part = "struct<n: bigint, mean: double, spread: double>"
    met = tiles.tiles(points, group, key, vector, fold, "n long, mean double, spread double, max double, min double")
    own = met.groupBy(group).agg(F.max("max").alias("max"), F.min("min").alias("min"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "spread")))).alias("parts"))

    def together(x: Column, y: Column) -> Column:
        gap, both = y["mean"] - x["mean"], x["n"] + y["n"]
        return F.struct(both.alias("n"), (x["mean"] + gap * y["n"] / both).alias("mean"), (x["spread"] + y["spread"] + gap * gap * x["n"] * y["n"] / both).alias("spread")).cast(part)

    whole = F.aggregate("parts", F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("spread")).cast(part), together)
    own = own.select(group, whole.alias("w"), "max", "min")
    some = lambda x: F.when(F.col("w.n") > 0, x)
    return own.select(group, some(F.col("w.mean")).alias("mean"), some(F.sqrt(F.col("w.spread") / F.col("w.n"))).alias("std"), "max", "min")


def cross_contacts(points: DataFrame, group: str, key: str, vector: str, role: tuple[Column, Column], cutoff: float) -> DataFrame:
    """(group, n, weight): how many pairs of a row of each role are nearer than the cutoff, and the sum of exp(-distance) over them. A group without such pairs has no row."""

    def fold(a: tiles.Block, b: tiles.Block, same: bool) -> dict:
        n, weight = 0, 0.0
        for _, _, d, _ in tiles.chunks(a, b, same, near=tiles.near_limits(cutoff)):
            d = d[d < cutoff]
            n += len(d)
            weight += float(np.exp(np.negative(d, out=d), out=d).sum())
        return {"n": [n], "weight": [weight]} if n else {}

    met = tiles.tiles(points, group, key, vector, fold, "n long, weight double", role=role)
    return met.groupBy(group).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def weighted_pair_histogram(points: DataFrame, group: str, key: str, vector: str, prop: str, combiners: tuple[str, ...], centres: list[float], smear: float, cutoff: float, lower: float) -> DataFrame:
    """(group, combiner, bin, weight): the sum over a group's pairs strictly between two distances of the combined property times exp(-smear * (distance - centre) squared).

    Each tile of pairs leaves one row with its sums. A group without such pairs has no row; a pair with a null property adds nothing.
    """

    def fold(a: tiles.Block, b: tiles.Block, same: bool) -> dict:
        sums, n = np.zeros((len(combiners), len(centres))), 0
        for i, j, d, mask in tiles.chunks(a, b, same, near=tiles.near_limits(cutoff, lower)):
            inside = (d < cutoff) & (d > lower)
            if mask is not None:
                inside &= mask
            n += int(np.count_nonzero(inside))
            props = [np.where(inside, tiles.combined(c, a, b, i, j, (prop, prop), True), 0.0).ravel() for c in combiners]
            props = [np.nan_to_num(p, copy=False, nan=0.0, posinf=np.inf, neginf=-np.inf) for p in props]
            d[~inside] = 0.0
            for y, centre in enumerate(centres):
                w = d - centre
                w *= w
                w *= -smear
                np.exp(w, out=w)
                for x, p in enumerate(props):
                    sums[x, y] += np.dot(p, w.ravel())
        return {"n": [n], "sums": [sums.ravel().tolist()]} if n else {}

    met = tiles.tiles(points, group, key, vector, fold, "n long, sums array<double>", columns=(prop,))
    sums = met.groupBy(group).agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(combiners) * len(centres))])
    spread = F.array(*[F.struct(F.lit(c).alias("combiner"), F.lit(j).alias("bin"), F.col(f"s{i * len(centres) + j}").alias("weight")) for i, c in enumerate(combiners) for j in range(len(centres))])
    return sums.select(group, F.explode(spread).alias("x")).select(group, "x.combiner", "x.bin", "x.weight")


def nearest_point(points: DataFrame, x: float, y: float, by: list[str], name: str, birth: str = "birth", persistence: str = "persistence") -> DataFrame:
    """Of each group the point nearest to (x, y) in the plane of birth and persistence."""
    d = (F.col(birth) - x) * (F.col(birth) - x) + (F.col(persistence) - y) * (F.col(persistence) - y)
    return points.groupBy(*by).agg(F.min(F.struct(d.alias("d"), F.col(name).alias(name))).alias("m")).select(*by, f"m.{name}")


def box_side(points: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """The side of a molecule's box: its largest distance between two sites. Null where no pair has one; a NaN is larger than all others."""

    def fold(a: tiles.Block, b: tiles.Block, same: bool) -> dict:
        most = [float(d.max() if mask is None else d.max(where=mask, initial=-math.inf)) for _, _, d, mask in tiles.chunks(a, b, same)]
        most = [x for x in most if x > -math.inf or math.isnan(x)]
        return {"side": [float(np.max(most)) if most else None]} if tiles.pairs_of(a, b, same) else {}

    return tiles.tiles(points, group, key, vector, fold, "side double").groupBy(group).agg(F.max("side").alias("side"))


def radius_neighbours(structures: DataFrame, sites: DataFrame, cutoff: float) -> DataFrame:
    """(struct_id, site_id, other, i, j, k, distance): the images of all sites within a distance of each site, itself left out.

    structures: (struct_id, lattice of three row vectors); sites: (struct_id, site_id, x, y, z). Along each axis as many cells are searched as
    reach the cutoff by the cell's perpendicular width and the spread of the sites; a structure's sites and images must fit a task.
    """
    v = [[F.col("lattice")[r][c] for c in range(3)] for r in range(3)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: sum((x * y for x, y in zip(p, q)), F.lit(0.0))
    normal = [cross(v[1], v[2]), cross(v[2], v[0]), cross(v[0], v[1])]
    volume = F.abs(dot(v[0], normal[0]))
    placed = sites.select(F.col("struct_id").alias("s"), "site_id", "x", "y", "z").join(structures.select("struct_id", "lattice"), F.col("s") == F.col("struct_id"))
    at = [dot([F.col(c) for c in "xyz"], n) / volume for n in normal]
    cells = placed.groupBy(F.col("s").alias("cs")).agg(F.first("lattice").alias("cell"), *[F.max(F.ceil(F.lit(cutoff) / (volume / F.sqrt(dot(n, n)))).cast("int")).alias(f"n{r}") for r, n in enumerate(normal)], *[F.ceil(F.max(f) - F.min(f)).cast("int").alias(f"w{r}") for r, f in enumerate(at)])
    image = sites.select(F.col("struct_id").alias("is"), F.col("site_id").alias("other"), *[F.col(c).alias(f"{c}0") for c in "xyz"]).join(cells, F.col("is") == F.col("cs"))
    for r, n in enumerate("ijk"):
        most = F.col(f"n{r}") + F.col(f"w{r}")
        image = image.withColumn(n, F.explode(F.sequence(-most, most)))
    moved = [(F.col(f"{c}0") + sum((F.col(n) * F.col("cell")[r][x] for r, n in enumerate("ijk")), F.lit(0.0))).alias(f"{c}2") for x, c in enumerate("xyz")]
    image = image.select("is", "other", "i", "j", "k", *moved)
    met = sites.select("struct_id", "site_id", "x", "y", "z").join(image, F.col("struct_id") == F.col("is")).where("site_id <> other or i <> 0 or j <> 0 or k <> 0")
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0)))
    return met.withColumn("distance", d).where(F.col("distance") <= cutoff).select("struct_id", "site_id", "other", "i", "j", "k", "distance")


def radius_totals(structures: DataFrame, sites: DataFrame, cutoff: float) -> DataFrame:
    """(struct_id, site_id, n, total): how many images radius_neighbours() finds of each site, and the sum of their distances. Sites without one have no row.

    Blocks of a structure's sites meet in tiles, in parts that stand together; an image of a part that is out of reach as a whole is passed over.
    """
    cell = structures.select(F.col("struct_id").alias("__s"), F.flatten("lattice").alias("__c"))
    own = sites.join(cell, F.col("struct_id") == F.col("__s")).withColumn("__x", F.concat(F.array(*[F.col(c).cast("double") for c in "xyz"]), "__c"))

    def placed(block: tiles.Block) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array([r for r, x in enumerate(block.x) if x is not None and len(x) == 12 and (np.abs(x) < 1e100).all()], int)
        at = np.array([block.x[r][:3] for r in rows]).reshape(-1, 3)
        if not len(rows):
            return rows, at
        span = np.maximum(np.ptp(at, axis=0), 1e-300)
        order = np.argsort(np.minimum(((at - at.min(axis=0)) / span * 4).astype(int), 3) @ (16, 4, 1), kind="stable")
        return rows[order], at[order]

    def reach(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """Which shifts bring some of b's box near a's."""
        low, high = b.min(axis=0) + shifts, b.max(axis=0) + shifts
        gap = np.maximum(0, np.maximum(low - a.max(axis=0), a.min(axis=0) - high))
        return np.flatnonzero((gap * gap).sum(axis=1) <= cutoff * cutoff * (1 + tiles.NEAR))

    near = tiles.near_limits(cutoff)

    def fold(a: tiles.Block, b: tiles.Block, same: bool) -> dict:
        (i, p), (j, q) = placed(a), placed(b)
        if not len(i) or not len(j):
            return {}
        lattice = a.x[i[0]][3:].reshape(3, 3)
        inverse, both = np.linalg.inv(lattice), np.concatenate([p, q])
        # Rows of the inverse's columns are as long as one over the cell's widths.
        most = np.ceil(cutoff * np.linalg.norm(inverse, axis=0) + np.ptp(both @ inverse, axis=0) + 1e-9).astype(int)
        images = np.stack(np.meshgrid(*[np.arange(-m, m + 1) for m in most], indexing="ij"), axis=-1).reshape(-1, 3)
        images = images[reach(p, q, images @ lattice)]
        shifts, centre, one = images @ lattice, both.mean(axis=0), np.ones
        count, total = [np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)], [np.zeros(len(a)), np.zeros(len(b))]
        for r in range(0, len(i), tiles.ROWS):
            x, xi = p[r : r + tiles.ROWS], i[r : r + tiles.ROWS]
            u = x - centre
            u = np.hstack([-2 * u, (u * u).sum(axis=1, keepdims=True), one((len(u), 1))])
            for c in range(0, len(j), tiles.COLUMNS // 4):
                y, yj = q[c : c + tiles.COLUMNS // 4], j[c : c + tiles.COLUMNS // 4]
                for image, shift in ((images[t], shifts[t]) for t in reach(x, y, shifts)):
                    v = y - centre + shift
                    v2 = (v * v).sum(axis=1)
                    d = u @ np.vstack([v.T, one(len(v)), v2])
                    low = d < 1e-6 * (u[:, 3].max() + v2.max())
                    np.sqrt(np.maximum(d, 0, out=d), out=d)
                    wrong = near(d) | low
                    if wrong.any():
                        k, m = np.nonzero(wrong)
                        exact = np.zeros(len(k))
                        for axis in range(3):
                            moved = y[m, axis] + (0.0 + image[0] * lattice[0, axis] + image[1] * lattice[1, axis] + image[2] * lattice[2, axis])
                            exact += (x[k, axis] - moved) * (x[k, axis] - moved)
                        d[k, m] = np.sqrt(exact)
                    inside = d <= cutoff
                    if same and not image.any():
                        inside &= a.code[xi][:, None] != b.code[yj][None, :]
                    d *= inside
                    count[0][xi] += inside.sum(axis=1)
                    total[0][xi] += d.sum(axis=1)
                    if not same:
                        count[1][yj] += inside.sum(axis=0)
                        total[1][yj] += d.sum(axis=0)
        sides = [0] if same else [0, 1]
        return {"site_id": pa.concat_arrays([(a, b)[s].keys for s in sides]), "n": np.concatenate([count[s] for s in sides]), "total": np.concatenate([total[s] for s in sides])}

    met = tiles.tiles(own, "struct_id", "site_id", "__x", fold, "site_id KEY, n long, total double")
    return met.groupBy("struct_id", "site_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")


def rank_within(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
