"""Train, validation and test splits and folds. A split is a column of the row table, never a list of positions.

Randomness is the order of md5(seed:key): the same on every run, partitioning and engine.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.shared import quantiles, ranked, running, written

QUARTERS = (0.0, 0.25, 0.5, 0.75, 1.0)


def check_fractions(*fractions: float) -> None:
    """Raises unless each is in [0, 1] and their sum is 1."""
    if any(not 0 <= f <= 1 for f in fractions):
        raise ValueError(f"fractions must be in [0, 1]: {fractions}")
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError(f"fractions must add up to 1: {fractions}")


def sizes(n: int, train: float, valid: float) -> tuple[int, int, int]:
    """Rows of train (rounded down), valid (rounded up) and test (the rest)."""
    a = int(n * train + 1e-9)
    b = min(n - a, -int(-n * valid // 1 - (1e-9 if valid else 0)) if valid else 0)
    return a, b, n - a - b


def order_of(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _label(rank: Column, train: Column, valid: Column) -> Column:
    return F.when(rank < train, "train").when(rank < train + valid, "valid").otherwise("test")


def _quota(n: Column, train: float, valid: float) -> tuple[Column, Column]:
    a = F.floor(n * train + 1e-9)
    b = F.least(n - a, F.ceil(n * valid - 1e-9)) if valid else F.lit(0)
    return a, b


def split_random(df: DataFrame, key: str, train: float, valid: float = 0.0, seed: int = 0) -> DataFrame:
    """df with a column split; rows are dealt by their hashed order."""
    check_fractions(train, valid, 1 - train - valid)
    own = ranked(df.withColumn("__o", order_of(F.col(key), seed)), "__o", key, name="__r")
    a, b, _ = sizes(own.count(), train, valid)
    return own.withColumn("split", _label(F.col("__r"), F.lit(a), F.lit(b))).drop("__o", "__r")


def split_grouped(df: DataFrame, group: str, train: float, valid: float = 0.0, seed: int = 0) -> DataFrame:
    """df with a column split; groups are dealt whole, by number of groups. A null group is one group."""
    check_fractions(train, valid, 1 - train - valid)
    groups = df.select(F.col(group).alias("__g")).distinct()
    dealt = split_random(groups.withColumn("__gk", F.coalesce(F.col("__g").cast("string"), F.lit("null"))), "__gk", train, valid, seed).select("__g", "split")
    return df.join(dealt, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def is_categorical(df: DataFrame, column: str) -> bool:
    """Whether a column's values are classes: integers are, fractions and strings aren't taken for such."""
    return isinstance(df.schema[column].dataType, (T.IntegralType, T.BooleanType))


def quantile_bin(df: DataFrame, column: str, q: tuple[float, ...] = QUARTERS, name: str = "bin") -> DataFrame:
    """df with the column's bin from 0, closed on the right, the first on both sides; equal edges count once."""
    edges = sorted(set(x for x in quantiles(df, column, q) if x is not None))
    inner = edges[1:-1]
    value = F.col(column)
    return df.withColumn(name, F.when(value.isNotNull(), sum(((value > F.lit(e)).cast("int") for e in inner), F.lit(0))))


def _per_stratum(df: DataFrame, stratum: str, key: str, seed: int, slices: int) -> DataFrame:
    """df with the row's number in its stratum, in hashed order, from 0, and the stratum's size as __n.

    Strata may hold a third of all rows each, so they are ranked in slices of the hash's first digit: a row's number
    is that in its slice and the sizes of the slices before.
    """
    own = df.withColumn("__o", order_of(F.col(key), seed)).withColumn("__s", F.substring("__o", 1, slices))
    count = own.groupBy(stratum, "__s").agg(F.count("*").alias("__c"))
    before = count.withColumn("__before", F.sum("__c").over(Window.partitionBy(stratum).orderBy("__s")) - F.col("__c")).withColumn("__n", F.sum("__c").over(Window.partitionBy(stratum)))
    before = before.select(F.col(stratum).alias("__st"), F.col("__s").alias("__sl"), "__before", "__n")
    place = F.row_number().over(Window.partitionBy(stratum, "__s").orderBy("__o", key)) - 1
    met = own.withColumn("__p", place).join(before, F.col(stratum).eqNullSafe(F.col("__st")) & (F.col("__s") == F.col("__sl")))
    return met.withColumn("__r", F.col("__p") + F.col("__before")).drop("__o", "__s", "__p", "__before", "__st", "__sl")


def split_stratified(df: DataFrame, key: str, stratum: str, train: float, valid: float = 0.0, seed: int = 0, slices: int = 2) -> DataFrame:
    """df with a column split; every stratum is dealt in the same shares."""
    check_fractions(train, valid, 1 - train - valid)
    own = _per_stratum(df, stratum, key, seed, slices)
    return own.withColumn("split", _label(F.col("__r"), *_quota(F.col("__n"), train, valid))).drop("__r", "__n")


def mode(column: str) -> Column:
    """The most frequent value, the smallest of several: to be aggregated over (value, n) rows."""
    return F.min_by(column, F.struct(-F.col("n"), F.col(column)))


def group_centres(df: DataFrame, group: str, value: str, categorical: bool = False) -> DataFrame:
    """(group, centre): the median of a group's values, or their mode for classes."""
    if not categorical:
        return df.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("centre"))
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return counted.groupBy(group).agg(mode(value).alias("centre"))


def split_grouped_stratified(df: DataFrame, group: str, value: str, train: float, valid: float = 0.0, seed: int = 0, q: tuple[float, ...] = QUARTERS, categorical: bool = False) -> DataFrame:
    """df with a column split; groups are dealt whole, in the same shares of each bin of their centres."""
    centres = group_centres(df, group, value, categorical)
    classed = centres.withColumn("bin", F.col("centre")) if categorical else quantile_bin(centres, "centre", q)
    dealt = split_stratified(classed, group, "bin", train, valid, seed).select(F.col(group).alias("__g"), "split")
    return df.join(dealt, F.col(group) == F.col("__g")).drop("__g")


def split_by_quantiles(df: DataFrame, column: str, train: float, valid: float = 0.0, seed: int = 0, q: tuple[float, ...] | None = None) -> DataFrame:
    """df with a column split; quantile bins of a density or a year are the groups, two or three unless q says more."""
    bins = q or tuple(i / (3 if valid else 2) for i in range((3 if valid else 2) + 1))
    return split_grouped(quantile_bin(df, column, bins, "__bin"), "__bin", train, valid, seed).drop("__bin")


def split_ordered(df: DataFrame, key: str, column: str, train: float, valid: float = 0.0) -> DataFrame:
    """df with a column split in the order of a column, ties by key: what trains is never later than what tests."""
    own = ranked(df, column, key, name="__r")
    a, b, _ = sizes(own.count(), train, valid)
    return own.withColumn("split", _label(F.col("__r"), F.lit(a), F.lit(b))).drop("__r")


def fold_plain(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """df with a column fold: k blocks of the hashed order whose sizes differ by one at most, the larger first."""
    own = ranked(df.withColumn("__o", order_of(F.col(key), seed)), "__o", key, name="__r")
    n = own.count()
    small, more = divmod(n, k)
    at = F.col("__r")
    fold = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / max(small, 1)))
    return own.withColumn("fold", fold.cast("int")).drop("__o", "__r")


def fold_stratified(df: DataFrame, key: str, stratum: str, k: int, seed: int = 0, slices: int = 2) -> DataFrame:
    own = _per_stratum(df, stratum, key, seed, slices)
    return own.withColumn("fold", (F.col("__r") % k).cast("int")).drop("__r", "__n")


def fold_grouped(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """df with a column fold; groups in hashed order go round the folds."""
    groups = df.select(F.col(group).alias("__g")).distinct()
    own = ranked(groups.withColumn("__o", order_of(F.col("__g"), seed)), "__o", "__g", name="__r").select("__g", (F.col("__r") % k).cast("int").alias("fold"))
    return df.join(own, F.col(group) == F.col("__g")).drop("__g")


def fold_grouped_even(df: DataFrame, group: str, k: int, parts: int = 1000) -> DataFrame:
    """df with a column fold; the largest group goes to the lightest fold, one after the other.

    This is done one by one for the groups of more than a parts-th of a fold's share, of which there are k * parts at most. The small ones
    behind them fill up the folds: in the order of their sizes, by the running sum of these, each fold takes what it lacks.
    """
    count = written(df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n")), "groups")
    total = count.agg(F.sum("__n")).first()[0] or 0
    large = F.col("__n") * k * parts > total
    heavy = [(r["__g"], r["__n"]) for r in count.where(large).collect()]
    heap = [(0, i) for i in range(k)]
    rows = []
    for name, n in sorted(heavy, key=lambda x: (-x[1], x[0])):
        weight, fold = heapq.heappop(heap)
        rows.append((name, fold))
        heapq.heappush(heap, (weight + n, fold))
    kind = T.StructType([T.StructField("__g", count.schema["__g"].dataType), T.StructField("fold", T.IntegerType())])
    dealt = df.sparkSession.createDataFrame(rows, kind)
    small = count.where(~large)
    if len(heavy) < count.count():
        # Where a fold is over its share already, it takes none; the others take the small groups up to equal weight.
        weights = dict((i, w) for w, i in heap)
        level, room = total / k, {}
        for i in range(k):
            room[i] = max(0.0, level - weights[i])
        scale = (total - sum(weights.values())) / (sum(room.values()) or 1)
        ends, at = [], 0.0
        for i in range(k):
            at += room[i] * scale
            ends.append((i, at))
        own = running(small.withColumn("__o", F.format_string("%020d#%s", F.lit((1 << 62)) - F.col("__n"), F.col("__g").cast("string"))), "__o", "__n")
        fold = F.lit(k - 1)
        for i, end in reversed(ends[:-1]):
            fold = F.when(F.col("before___n") < end, i).otherwise(fold)
        dealt = dealt.union(own.select("__g", fold.cast("int").alias("fold")))
    return df.join(dealt, F.col(group) == F.col("__g")).drop("__g")


def fold_grouped_stratified(df: DataFrame, group: str, value: str, k: int, seed: int = 0, q: tuple[float, ...] = QUARTERS) -> DataFrame:
    classed = quantile_bin(group_centres(df, group, value), "centre", q)
    dealt = fold_stratified(classed, group, "bin", k, seed).select(F.col(group).alias("__g"), "fold")
    return df.join(dealt, F.col(group) == F.col("__g")).drop("__g")


def downsample(df: DataFrame, key: str, split: str, fraction: float, seed: int = 0) -> DataFrame:
    """The first floor(fraction * n) rows of every split in hashed order."""
    own = _per_stratum(df, split, key, seed, 2)
    return own.where(F.col("__r") < F.floor(F.col("__n") * fraction + 1e-9)).drop("__r", "__n")


def relabel_by_size(df: DataFrame, split: str = "split", names: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """df with its splits renamed in the order of their sizes, the largest first, ties by name."""
    count = sorted(df.groupBy(split).agg(F.count("*").alias("n")).collect(), key=lambda r: (-r.n, r[split]))
    to = F.create_map(*[F.lit(x) for r, name in zip(count, names) for x in (r[split], name)])
    return df.withColumn(split, to[F.col(split)])


def with_split(df: DataFrame, key: str, train: float = 0.7, valid: float = 0.0, seed: int = 0, group: str | None = None, stratum: str | None = None, sample_frac: float = 1.0, categorical: bool | None = None, q: tuple[float, ...] = QUARTERS, by_size: bool = False) -> DataFrame:
    """df with a column split, by what is given: groups in strata, groups, strata, or rows; then sample_frac of each split, and splits named by size if asked.

    A stratum column of classes is taken as it is, a continuous one in quantile bins; categorical says which, where the type doesn't.
    """
    classes = stratum is not None and (is_categorical(df, stratum) if categorical is None else categorical)
    if group and stratum:
        out = split_grouped_stratified(df, group, stratum, train, valid, seed, q, classes)
    elif group:
        out = split_grouped(df, group, train, valid, seed)
    elif stratum:
        own = df.withColumn("__stratum", F.col(stratum)) if classes else quantile_bin(df, stratum, q, "__stratum")
        out = split_stratified(own, key, "__stratum", train, valid, seed).drop("__stratum")
    else:
        out = split_random(df, key, train, valid, seed)
    if sample_frac < 1:
        out = downsample(out, key, "split", sample_frac, seed)
    return relabel_by_size(out) if by_size else out


def with_fold(df: DataFrame, key: str, k: int = 5, seed: int = 0, group: str | None = None, stratum: str | None = None, categorical: bool | None = None, q: tuple[float, ...] = QUARTERS) -> DataFrame:
    """df with a column fold, by what is given: groups in strata, even groups, strata, or rows."""
    classes = stratum is not None and (is_categorical(df, stratum) if categorical is None else categorical)
    if group and stratum:
        return fold_grouped_stratified(df, group, stratum, k, seed, q)
    if group:
        return fold_grouped_even(df, group, k)
    if stratum:
        own = df.withColumn("__stratum", F.col(stratum)) if classes else quantile_bin(df, stratum, q, "__stratum")
        return fold_stratified(own, key, "__stratum", k, seed).drop("__stratum")
    return fold_plain(df, key, k, seed)


def split_by_order(ordered: DataFrame, order: str, train: float, valid: float = 0.0, ascending: bool = False) -> DataFrame:
    """ordered, numbered from 0 in a column, with a column split: the first share of an order such as a farthest-first one trains; ascending turns the order round."""
    n = ordered.count()
    at = (n - 1 - F.col(order)) if ascending else F.col(order)
    a, b = int(n * train), int(n * valid)
    return ordered.withColumn("split", _label(at, F.lit(a), F.lit(b)))


def fold_by_order(ordered: DataFrame, order: str, k: int) -> DataFrame:
    """ordered with a column fold: k blocks of the order whose sizes differ by one at most, the larger first."""
    small, more = divmod(ordered.count(), k)
    at = F.col(order)
    fold = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / max(small, 1)))
    return ordered.withColumn("fold", fold.cast("int"))
