"""Shape descriptors from principal moments, prototype matching, and the farthest-first order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPES = ("pmi1", "pmi2", "pmi3", "npr1", "npr2", "rod", "disk", "sphere", "asphericity", "eccentricity", "inertial_shape_factor", "radius_of_gyration", "spherocity")


def shape_descriptors(points: DataFrame, by: str, mass: str | None = None, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(by, SHAPES) of points: ten sums a group by aggregation, then the eigenvalues of 3 x 3 matrices, in batches."""
    m = F.col(mass).cast("double") if mass else F.lit(1.0)
    x, y, z = (F.col(c).cast("double") for c in xyz)
    sums = points.groupBy(by).agg(F.sum(m).alias("m"), *[F.sum(m * a).alias(n) for n, a in zip("xyz", (x, y, z))], *[F.sum(m * a * b).alias(n) for n, a, b in (("xx", x, x), ("yy", y, y), ("zz", z, z), ("xy", x, y), ("xz", x, z), ("yz", y, z))])

    def moments(batches):
        for d in batches:
            if not len(d):
                continue
            w = d["m"].to_numpy()
            c = np.stack([d[n].to_numpy() / w for n in "xyz"], 1)
            s = np.empty((len(d), 3, 3))
            for i, j, n in ((0, 0, "xx"), (1, 1, "yy"), (2, 2, "zz"), (0, 1, "xy"), (0, 2, "xz"), (1, 2, "yz")):
                s[:, i, j] = s[:, j, i] = d[n].to_numpy() - w * c[:, i] * c[:, j]
            trace = np.trace(s, axis1=1, axis2=2)
            p1, p2, p3 = np.linalg.eigvalsh(trace[:, None, None] * np.eye(3) - s).T
            spread = np.linalg.eigvalsh(s / w[:, None, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                r1, r2 = p1 / p3, p2 / p3
                total = p1**2 + p2**2 + p3**2
                out = {
                    "pmi1": p1, "pmi2": p2, "pmi3": p3, "npr1": r1, "npr2": r2, "rod": r2 - r1, "disk": 2 - 2 * r2, "sphere": r1 + r2 - 1,
                    "asphericity": 0.5 * ((p3 - p1) ** 2 + (p3 - p2) ** 2 + (p2 - p1) ** 2) / total, "eccentricity": np.sqrt(np.maximum(p3**2 - p1**2, 0)) / p3,
                    "inertial_shape_factor": p2 / (p1 * p3), "radius_of_gyration": np.sqrt(trace / w), "spherocity": 3 * spread[:, 0] / spread.sum(axis=1),
                }
            yield pd.DataFrame({by: d[by], **out})

    kind = points.schema[by].dataType.simpleString()
    return sums.mapInPandas(moments, f"{by} {kind}, " + ", ".join(f"{s} double" for s in SHAPES))


def superposition_rmsd(a: np.ndarray, b: np.ndarray, rescale: bool = True) -> float:
    """The root mean square distance of two equally long point lists after the best rotation, shift and, if asked, scale."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    u, s, v = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u) * np.linalg.det(v)) or 1
    scale = s.sum() / (a**2).sum() if rescale and (a**2).sum() else 1.0
    return float(np.sqrt(max(0.0, ((b**2).sum() - 2 * scale * s.sum() + scale**2 * (a**2).sum()) / len(a))))


def match_prototypes(blocks: DataFrame, prototypes: list[tuple[str, list[list[float]]]], key: str, xyz: str = "xyz", rescale: bool = True, mismatch: float = 1000.0) -> DataFrame:
    """(key, prototype, rmsd): each block's points against each prototype of as many points; others are filled with `mismatch`."""
    known = [(n, np.array(p, float)) for n, p in prototypes]

    def match(batches):
        for d in batches:
            rows = [(k, n, superposition_rmsd(np.array([list(q) for q in p]), t, rescale) if len(p) == len(t) else mismatch) for k, p in zip(d[key], d[xyz]) for n, t in known]
            yield pd.DataFrame(rows, columns=[key, "prototype", "rmsd"])

    kind = blocks.schema[key].dataType.simpleString()
    return blocks.select(key, xyz).mapInPandas(match, f"{key} {kind}, prototype string, rmsd double")


def kennard_stone(x: np.ndarray, scale: bool = True, centre: str = "mean") -> np.ndarray:
    """Row numbers, the one farthest from the centre first, then always the one farthest from those before."""
    x = np.asarray(x, float)
    if scale:
        deviation = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(deviation > 0, deviation, 1)
    middle = np.median(x, axis=0) if centre == "median" else x.mean(axis=0)
    first = int(((x - middle) ** 2).sum(axis=1).argmax())
    order, least, left = [first], ((x - x[first]) ** 2).sum(axis=1), np.ones(len(x), bool)
    left[first] = False
    while left.any():
        i = int(np.where(left, least, -1.0).argmax())
        order.append(i)
        left[i] = False
        least = np.minimum(least, ((x - x[i]) ** 2).sum(axis=1))
    return np.array(order)


def kennard_stone_order(df: DataFrame, key: str, features: str, within: str, scale: bool = True, centre: str = "mean") -> DataFrame:
    """(within, key, order) for each group of `within`. The order is sequential and quadratic by definition: groups are the unit of work."""

    def order(d):
        d = d.sort_values(key).reset_index(drop=True)
        at = kennard_stone(np.stack([np.asarray(v, float) for v in d[features]]), scale, centre)
        return pd.DataFrame({within: d[within].iloc[0], key: d[key].to_numpy()[at], "order": np.arange(len(at))})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, within)}
    return df.select(within, key, features).groupBy(within).applyInPandas(order, f"{within} {kinds[within]}, {key} {kinds[key]}, order int")
