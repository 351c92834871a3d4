"""Histograms on fixed grids, in one and two dimensions, kernel sums and voxels. Every grid is dense: empty bins are rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_count(low: float, high: float, width: float) -> int:
    return math.ceil(round((high + width - low) / width, 9)) - 1


def bin_of(x: Column, low: float, high: float, n: int, width: float) -> Column:
    """The bin from 0; the last one is closed on the right; null outside."""
    top = low + n * width
    return F.when((x >= low) & (x < top), F.floor((x - low) / width)).when(x == top, F.lit(n - 1)).cast("long")


def grid(df: DataFrame, by: list[str], **sizes: int) -> DataFrame:
    """Every group with every combination of bins."""
    out = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    for name, n in sizes.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return out


def _filled(whole: DataFrame, counted: DataFrame, on: list[str], value: str = "n") -> DataFrame:
    other = counted.select(*[F.col(c).alias(f"__{c}") for c in on], value)
    met = whole.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], "left")
    return met.select(*whole.columns, F.coalesce(value, F.lit(0)).alias(value))


def histogram(df: DataFrame, by: list[str], x: str, low: float, high: float, width: float, density: bool = False, shells: bool = False) -> DataFrame:
    """(by, bin, n): counts of x; density: shares by width; shells: counts by the volume of the spherical shell. Nulls and values outside count nowhere."""
    n = bin_count(low, high, width)
    counted = df.select(*by, bin_of(F.col(x).cast("double"), low, high, n, width).alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    out = _filled(grid(df, by, bin=n), counted, [*by, "bin"])
    if density:
        total = out.groupBy(*by).agg(F.sum("n").alias("__total")).select(*[F.col(c).alias(f"__{c}") for c in by], "__total")
        out = out.join(total, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] if by else F.lit(True)).select(*by, "bin", (F.col("n") / (F.col("__total") * width)).alias("n"))
    if shells:
        inner, outer = F.col("bin") * width + low, (F.col("bin") + 1) * width + low
        volume = 4 / 3 * math.pi * (outer * outer * outer - inner * inner * inner)
        out = out.withColumn("n", F.col("n") / volume)
    return out


def histogram2d(df: DataFrame, by: list[str], x: str, y: str, nx: int, ny: int) -> DataFrame:
    """(by, ix, iy, n, density) over the range of each group's data; a group whose values are all equal is one wide bin's width 1."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = own.groupBy(*by).agg(*[g(F.col(c).cast("double")).alias(f"__{c}{k}") for c in (x, y) for k, g in (("lo", F.min), ("hi", F.max))], F.count("*").alias("__rows"))
    right = ends.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col(f"__{c}{k}") for c in (x, y) for k in ("lo", "hi")], "__rows")
    met = own.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] if by else F.lit(True))

    def place(c: str, n: int) -> Column:
        span = F.col(f"__{c}hi") - F.col(f"__{c}lo")
        return F.when(span > 0, F.least(F.floor((F.col(c) - F.col(f"__{c}lo")) / span * n), F.lit(n - 1))).otherwise(0).cast("long")

    area = lambda c, n: F.when(F.col(f"__{c}hi") > F.col(f"__{c}lo"), F.col(f"__{c}hi") - F.col(f"__{c}lo")).otherwise(1.0) / n
    counted = met.select(*by, place(x, nx).alias("ix"), place(y, ny).alias("iy")).groupBy(*by, "ix", "iy").agg(F.count("*").alias("n"))
    out = _filled(grid(own, by, ix=nx, iy=ny), counted, [*by, "ix", "iy"])
    out = out.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] if by else F.lit(True))
    return out.select(*by, "ix", "iy", "n", (F.col("n") / (F.col("__rows") * area(x, nx) * area(y, ny))).alias("density"))


def kernel_density(values: DataFrame, by: list[str], x: str, low: float, high: float, points: int, factor: float) -> DataFrame:
    """(by, point, density): a Gaussian kernel estimate on `points` even points; the width is factor times the sample deviation."""
    own = values.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__x"))
    width = own.groupBy(*by).agg((F.stddev_samp("__x") * factor).alias("__h"), F.count("*").alias("__n")).select(*[F.col(c).alias(f"__{c}") for c in by], "__h", "__n")
    met = own.join(width, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] if by else F.lit(True))
    met = met.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.lit(low) + F.col("point") * ((high - low) / (points - 1)) - F.col("__x")) / F.col("__h")
    return met.groupBy(*by, "point").agg(F.sum(F.exp(-z * z / 2) / (F.col("__h") * F.col("__n") * math.sqrt(2 * math.pi))).alias("density"))


def smear(counts: DataFrame, by: list[str], value: str, low: float, high: float, points: int, factor: float) -> DataFrame:
    """(by, point, density): a histogram's counts smeared: the kernel estimate of the counts themselves, empty bins included, on an even grid."""
    return kernel_density(counts, by, value, low, high, points, factor)


def voxel_distances(points: DataFrame, by: list[str], axes: tuple[str, str, str], bounds: tuple[tuple[float, float], ...], n: int) -> DataFrame:
    """(by, vx, vy, vz, distance): from the centre of every voxel of a group's grid to its nearest point.

    An equi-join on the group whose voxels are dealt by their first coordinate; only a minimum a voxel is left of it.
    """
    own = points.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(a).cast("double").alias(f"_p{i}") for i, a in enumerate(axes)])
    whole = grid(points, by, vx=n, vy=n, vz=n)
    centre = [F.lit(lo) + (F.col(v) + 0.5) * ((hi - lo) / n) for v, (lo, hi) in zip(("vx", "vy", "vz"), bounds)]
    met = whole.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] if by else F.lit(True))
    d2 = sum(((c - F.col(f"_p{i}")) * (c - F.col(f"_p{i}")) for i, c in enumerate(centre)), F.lit(0.0))
    return met.groupBy(*by, "vx", "vy", "vz").agg(F.sqrt(F.min(d2)).alias("distance"))


def voxel_of(x: Column, low: float, high: float, n: int) -> Column:
    """The voxel from 0 on one axis, clipped to the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - low) / ((high - low) / n)))).cast("int")


def voxels(points: DataFrame, by: list[str], axes: tuple[str, str, str], bounds: tuple[tuple[float, float], ...], n: int, mean_of: str | None = None) -> DataFrame:
    """(by, vx, vy, vz, binary, density, mean): occupancy, share of the group's points and mean property of every voxel."""
    own = points.select(*by, *[voxel_of(F.col(a), lo, hi, n).cast("long").alias(v) for a, (lo, hi), v in zip(axes, bounds, ("vx", "vy", "vz"))], *([F.col(mean_of).cast("double").alias("__p")] if mean_of else [F.lit(None).cast("double").alias("__p")]))
    counted = own.groupBy(*by, "vx", "vy", "vz").agg(F.count("*").alias("n"), F.avg("__p").alias("mean"))
    total = own.groupBy(*by).agg(F.count("*").alias("__total")).select(*[F.col(c).alias(f"__{c}") for c in by], "__total")
    whole = grid(own, by, vx=n, vy=n, vz=n)
    on = [*by, "vx", "vy", "vz"]
    met = whole.join(counted.select(*[F.col(c).alias(f"_{c}") for c in on], "n", "mean"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left")
    met = met.join(total, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] if by else F.lit(True))
    return met.select(*on, (F.coalesce("n", F.lit(0)) > 0).cast("int").alias("binary"), (F.coalesce("n", F.lit(0)) / F.col("__total")).alias("density"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def voxel_neighbours(occupied: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of occupied voxels that touch, each with itself left out: an equi-join on shifted coordinates."""
    moved = occupied.select(*[F.col(c).alias(f"_{c}") for c in by], "vx", "vy", "vz")
    for v in ("vx", "vy", "vz"):
        moved = moved.withColumn(f"d{v}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    moved = moved.where("dvx <> 0 or dvy <> 0 or dvz <> 0").select(*[F.col(f"_{c}") for c in by], *[F.col(v).alias(f"from_{v}") for v in ("vx", "vy", "vz")], *[(F.col(v) + F.col(f"d{v}")).alias(f"_{v}") for v in ("vx", "vy", "vz")])
    return occupied.join(moved, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "vx", "vy", "vz")]).select(*by, "from_vx", "from_vy", "from_vz", "vx", "vy", "vz")
