"""Cleaning a dataset frame: projections by prefix, null drops, ordered deduplication, subsets, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIXES = {"info": "info.", "feature": "features.", "label": "outputs.", "flavor": "flavor."}


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    """The columns whose names begin with prefix, in order."""
    return [c for c in df.columns if c.startswith(prefix)]


def project_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for p in prefixes for c in prefixed(df, p)])


def drop_nulls(df: DataFrame, *prefixes: str) -> DataFrame:
    """Rows with no null or NaN in any column that begins with one of the prefixes."""
    subset = [f"`{c}`" for p in prefixes for c in prefixed(df, p)]
    return df.na.drop(how="any", subset=subset) if subset else df


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the order given, which must be total within a key.

    The first row is found by a struct minimum, combined before the shuffle: a hot key doesn't meet in one task.
    """
    rest = [c for c in df.columns]
    ordered = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    return df.groupBy(*keys).agg(F.min(ordered).alias("__first")).select("__first.row.*")


def keep_first_in_turn(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """keep_first by each key, one after the other, on the survivors of the one before."""
    for key in keys:
        df = keep_first(df, [key], order)
    return df


def take_positions(df: DataFrame, row_id: str, positions: DataFrame) -> DataFrame:
    """The rows at positions (pos, row_id), renumbered by pos. Repeated positions repeat rows."""
    own = positions.select(F.col("pos").alias("__pos"), F.col("row_id").alias("__row"))
    return df.join(own, F.col(row_id) == F.col("__row")).drop("__row", row_id).withColumnRenamed("__pos", row_id)


def take_columns(df: DataFrame, row_id: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, columns) of the rows at positions (pos, row_id): labels, years, densities or file names of a subset, in its order."""
    own = rows.select(F.col("pos").alias("__pos"), F.col("row_id").alias("__row"))
    return df.join(own, F.col(row_id) == F.col("__row")).select(F.col("__pos").alias("pos"), *[F.col(f"`{c}`") for c in columns])


def renamed(df: DataFrame, parts: dict[str, str]) -> DataFrame:
    """df with the parts of its column names replaced, one after the other."""
    names = {c: c for c in df.columns}
    for old, new in parts.items():
        names = {c: n.replace(old, new) for c, n in names.items()}
    return df.withColumnsRenamed(names)


def with_elements(sites: DataFrame, key: str, symbol: str, symbols: list[str]) -> DataFrame:
    """(key, symbol): the sites whose symbol is in the list; a key without one has a single null."""
    own = sites.where(F.col(symbol).isin(symbols)).select(F.col(key).alias("__k"), F.col(symbol).alias("__s"))
    return sites.select(key).distinct().join(own, F.col(key) == F.col("__k"), "left").select(key, F.col("__s").alias(symbol))


def members_of(links: DataFrame, nodes: DataFrame, pattern: str, group: str) -> DataFrame:
    """The nodes (node, name) that links (node, of) put into a group of nodes whose name is like the pattern: a provenance query. group: the group's column in the result."""
    groups = nodes.where(F.col("name").like(pattern)).select(F.col("node").alias("__g"), F.col("name").alias(group))
    return links.join(groups, F.col("of") == F.col("__g")).select(F.col("node").alias("__n"), group).join(nodes, F.col("node") == F.col("__n")).drop("__n")


def flat(df: DataFrame, column: str) -> DataFrame:
    """df with a column of nested arrays, however deep, as one array."""
    kind = df.schema[column].dataType
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        df, kind = df.withColumn(column, F.flatten(column)), kind.elementType
    return df


def where_flavor(df: DataFrame, flavor: str) -> DataFrame:
    return df.where(F.col(f"`flavor.{flavor}`"))


def smallest_type(low: float, high: float, kind: T.DataType) -> str:
    """The narrowest type whose range holds the values: FLOAT for fractions, BYTE to LONG for integers."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "float" if abs(low) < 3.4e38 and abs(high) < 3.4e38 else "double"
    for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)):
        if -(1 << bits - 1) <= low and high < 1 << bits - 1:
            return name
    return "bigint"


def narrowed_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type of every numeric column, from one pass of minima and maxima."""
    numeric = [f for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.FractionalType))]
    if not numeric:
        return {}
    row = df.agg(*[g(F.col(f"`{f.name}`")).alias(f"{k}{i}") for i, f in enumerate(numeric) for k, g in (("lo", F.min), ("hi", F.max))]).first()
    return {f.name: smallest_type(row[f"lo{i}"], row[f"hi{i}"], f.dataType) for i, f in enumerate(numeric) if row[f"lo{i}"] is not None}


def compress(df: DataFrame) -> DataFrame:
    types = narrowed_types(df)
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    found = df.count()
    if found != n:
        raise ValueError(f"expected {n} rows, found {found}")
    return df


def expect_known(wanted: DataFrame, known: DataFrame, on: str) -> None:
    """Raises if a key of wanted isn't in known."""
    missing = [r[0] for r in wanted.select(on).join(known.select(on), on, "left_anti").limit(5).collect()]
    if missing:
        raise FileNotFoundError(f"missing: {missing}")


def check_choice(value: str, known: tuple[str, ...], what: str) -> str:
    if value not in known:
        raise ValueError(f"{what} {value!r} is not one of {', '.join(known)}")
    return value


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def max_version(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("version"))


def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value that comes last in order for each key, as a mapping keeps it."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def flatten_names(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, name with dots) of every leaf of nested structs."""
    out = []
    for f in schema:
        path = f"{prefix}`{f.name}`"
        out += flatten_names(f.dataType, path + ".") if isinstance(f.dataType, T.StructType) else [(path, path.replace("`", ""))]
    return out


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(p).alias(n) for p, n in flatten_names(df.schema)])


def numbered(df: DataFrame, partition: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Row numbers from 1 within partitions that a task can hold, such as a structure's sites."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
