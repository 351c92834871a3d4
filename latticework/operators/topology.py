"""Features of persistence diagrams given as rows (id, dim, birth, death), and the diagrams of dimension 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.aggregators import AGGREGATORS, finite
from latticework.operators.histogram import histogram2d


def with_persistence(diagrams: DataFrame) -> DataFrame:
    birth, death = (finite(F.col(c).cast("double")) for c in ("birth", "death"))
    return diagrams.withColumn("birth", birth).withColumn("death", death).withColumn("persistence", F.col("death") - F.col("birth"))


def diagram_stats(diagrams: DataFrame, by: list[str], names: tuple[str, ...]) -> DataFrame:
    """(by, quantity, aggregates) of births, deaths and persistences; what isn't finite is left out, nothing left gives 0."""
    own = with_persistence(diagrams)
    long = own.select(*by, F.explode(F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(q).alias("v")) for q in ("birth", "death", "persistence")])).alias("q")).select(*by, "q.quantity", "q.v")
    return long.groupBy(*by, "quantity").agg(*[F.coalesce(AGGREGATORS[n](F.col("v")).cast("double"), F.lit(0.0)).alias(n) for n in names])


def by_persistence(diagrams: DataFrame, by: list[str], key: str) -> DataFrame:
    """The diagrams' points with their order from 1 in each diagram, the most persistent first, ties by key. Points without a finite persistence come last."""
    from pyspark.sql import Window

    own = with_persistence(diagrams)
    return own.withColumn("order", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("persistence").desc_nulls_last(), key)))


def diagram_histogram(diagrams: DataFrame, by: list[str], nx: int, ny: int, y: str = "persistence") -> DataFrame:
    return histogram2d(with_persistence(diagrams), by, "birth", y, nx, ny)


def image_limits(diagrams: DataFrame, dim: str = "dim", tolerance: float = 0.1) -> DataFrame:
    """(dim, max_birth, max_persistence): the largest of the corpus, widened by the tolerance."""
    own = with_persistence(diagrams)
    return own.groupBy(dim).agg((F.max("birth") * (1 + tolerance)).alias("max_birth"), (F.max("persistence") * (1 + tolerance)).alias("max_persistence"))


def images(diagrams: DataFrame, by: list[str], pixels: tuple[int, int], spread: float, max_birth: float, max_persistence: float) -> DataFrame:
    """(by, px, py, v): Gaussians of the points, weighted by persistence, at the pixels' places. One row an id, image and pixel; every pixel is there."""
    own = with_persistence(diagrams).where("persistence is not null")
    for name, n in (("px", pixels[0]), ("py", pixels[1])):
        own = own.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x, y = F.col("px") * (max_birth / (pixels[0] - 1)), F.col("py") * (max_persistence / (pixels[1] - 1))
    r2 = (x - F.col("birth")) * (x - F.col("birth")) + (y - F.col("persistence")) * (y - F.col("persistence"))
    return own.groupBy(*by, "px", "py").agg(F.sum(F.col("persistence") * F.exp(-r2 / (2 * spread * spread))).alias("v"))


def pixel_place(px, py, pixels: tuple[int, int], max_birth: float, max_persistence: float) -> dict:
    """Columns of birth, persistence and death of a pixel."""
    b, p = px * max_birth / (pixels[0] - 1), py * max_persistence / (pixels[1] - 1)
    return {"birth": b, "persistence": p, "death": b + p}


def h0_diagrams(points: DataFrame, group: str, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(group, dim 0, birth 0, death): half the edges of the minimum spanning tree, one group's points at a time."""

    def tree(pdf):
        import numpy as np
        import pandas as pd

        p = pdf[list(xyz)].to_numpy(float)
        n = len(p)
        best, used, deaths = np.full(n, np.inf), np.zeros(n, bool), []
        best[0] = 0
        for _ in range(n):
            i = int(np.where(used, np.inf, best).argmin())
            used[i] = True
            deaths.append(best[i])
            best = np.minimum(best, np.sqrt(((p - p[i]) ** 2).sum(axis=1)))
        return pd.DataFrame({group: pdf[group].iloc[0], "dim": 0, "birth": 0.0, "death": [d / 2 for d in deaths[1:]]})

    kind = points.schema[group].dataType.simpleString()
    return points.select(group, *xyz).groupBy(group).applyInPandas(tree, f"{group} {kind}, dim int, birth double, death double")
