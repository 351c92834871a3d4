"""Aggregates by name over a group's values, and combiners of the two values of a pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _trimean(x: Column) -> Column:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (q[0] + 2 * q[1] + q[2]) / 4


#: mad isn't here: it takes two passes, see aggregate().
AGGREGATORS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_pop,
    "range": lambda x: F.max(x) - F.min(x),
    "mean": F.avg,
    "median": lambda x: F.percentile(x, F.lit(0.5)),
    "geomean": lambda x: F.exp(F.avg(F.ln(x))),
    "harmean": lambda x: F.count(x) / F.sum(1 / x),
    "trimean": _trimean,
    "inf": lambda x: F.max(F.abs(x)),
    "manhattan": lambda x: F.sum(F.abs(x)),
}
NAMES = (*list(AGGREGATORS)[:10], "mad", *list(AGGREGATORS)[10:])
#: What masked aggregates take over all values, masked or not.
UNMASKED = ("inf", "manhattan")

COMBINERS: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: a + b,
    "avg": lambda a, b: (a + b) / 2,
    "max": F.greatest,
    "min": F.least,
    "first": lambda a, b: a,
    "last": lambda a, b: b,
    "product": lambda a, b: a * b,
    "diff": lambda a, b: F.abs(b - a),
    "absdiff": lambda a, b: F.abs(b - a),
}


def aggregate(df: DataFrame, by: list[str], column: str, names: tuple[str, ...] = NAMES, mask: Column | None = None, spoil: bool = False) -> DataFrame:
    """One row for each group with a column for each aggregate of `names`.

    mask: rows for which it is true don't count, but for UNMASKED, and values that are NaN count as null. spoil: without a mask a NaN makes every aggregate of its group one, as in plain array arithmetic.
    Medians and quartiles are exact; a group's distinct values must fit a task, as a structure's do.
    """
    plain = F.col(column).cast("double")
    value = F.nanvl(plain, F.lit(None).cast("double"))
    shown = F.when(~mask, value) if mask is not None else value
    own = df.select(*by, value.alias("__all"), shown.alias("__x"), F.isnan(plain).alias("__nan"))
    spoilt = lambda c: c if mask is not None or not spoil else F.when(F.max(F.col("__nan").cast("int")) == 1, F.lit(float("nan"))).otherwise(c)
    simple = [spoilt(AGGREGATORS[n](F.col("__all" if n in UNMASKED else "__x"))).alias(n) for n in names if n != "mad"]
    if "mad" not in names:
        return own.groupBy(*by).agg(*simple)
    out = own.groupBy(*by).agg(*simple, F.percentile("__x", F.lit(0.5)).alias("__median"))
    # A null in a group's key must still meet its median.
    left, right = own.alias("l"), out.select(*[F.col(c).alias(f"__{c}") for c in by], "__median").alias("r")
    met = left.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or F.lit(True))
    mad = met.groupBy(*by).agg(spoilt(F.percentile(F.abs(F.col("__x") - F.col("__median")), F.lit(0.5))).alias("mad"))
    mad = mad.select(*[F.col(c).alias(f"__{c}") for c in by], "mad")
    return out.join(mad, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or F.lit(True)).select(*by, *names)


def combine(name: str, a: Column, b: Column) -> Column:
    return COMBINERS[name](a, b)
