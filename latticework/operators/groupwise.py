"""Features aggregated over roles, guests and species: long form inside, wide at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.aggregators import AGGREGATORS


def by_role(features: DataFrame, key: str, role: str, value: str, roles: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """(key, role, agg, value) for every key, role and aggregate; null where a key has no row of the role."""
    long = features.groupBy(F.col(key), F.col(role).alias("role")).agg(*[AGGREGATORS[n](F.col(value).cast("double")).cast("double").alias(n) for n in names])
    whole = features.select(F.col(key).alias("__k")).distinct().withColumn("__r", F.explode(F.array(*[F.lit(r) for r in roles])))
    met = whole.join(long, (F.col("__k") == F.col(key)) & (F.col("__r") == F.col("role")), "left")
    spread = F.explode(F.array(*[F.struct(F.lit(n).alias("agg"), F.col(f"`{n}`").alias("value")) for n in names]))
    return met.select(F.col("__k").alias(key), F.col("__r").alias("role"), spread.alias("a")).select(key, "role", "a.agg", "a.value")


def wide(long: DataFrame, key: str, columns: list[str], value: str = "value") -> DataFrame:
    """One row a key; the columns are those that the parameters name, not those that the data show."""
    name = F.concat_ws("_", *[c for c in long.columns if c not in (key, value)])
    return long.withColumn("__name", name).groupBy(key).pivot("__name", columns).agg(F.first(value))


def host_and_guests(features: DataFrame, key: str, role: str, value: str, names: tuple[str, ...]) -> DataFrame:
    """(key, host, one column for each aggregate over the guests)."""
    guest = F.when(F.col(role) != "host", F.col(value).cast("double"))
    return features.groupBy(key).agg(F.max(F.when(F.col(role) == "host", F.col(value).cast("double"))).alias("host"), *[AGGREGATORS[n](guest).alias(f"guest_{n}") for n in names])


def by_species_and_all(features: DataFrame, keys: list[str], species: str, value: str, names: tuple[str, ...], every: tuple[str, ...] = ()) -> DataFrame:
    """(keys, species or 'all', aggregates): grouping sets; species of `every` that a key lacks are filled with 0."""
    own = features.groupingSets([[*keys, species], [*keys]], *keys, species).agg(*[AGGREGATORS[n](F.col(value).cast("double")).alias(n) for n in names], F.grouping(species).alias("__g"))
    own = own.select(*keys, F.when(F.col("__g") == 1, "all").otherwise(F.col(species)).alias(species), *names)
    if not every:
        return own
    whole = features.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__s", F.explode(F.array(*[F.lit(s) for s in (*every, "all")])))
    met = whole.join(own, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(species) == F.col("__s")], "left")
    return met.select(*[F.col(f"__{k}").alias(k) for k in keys], F.col("__s").alias(species), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def composition(sites: DataFrame, key: str, properties: DataFrame, encodings: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """(key, <encoding>_<agg>): aggregates of the properties of all sites. properties: symbol and a column for each encoding."""
    met = sites.join(properties, "symbol")
    return met.groupBy(key).agg(*[AGGREGATORS[n](F.col(e).cast("double")).alias(f"{e}_{n}") for e in encodings for n in names])


def price_bound(sites: DataFrame, elements: DataFrame, key: str, weighted: bool = False) -> DataFrame:
    """(key, gravimetric): the elements' prices by mass share. elements: symbol, mass, price.

    Each distinct element counts once, as the published values do; weighted: as often as it stands in the structure.
    A structure with an element without price has a null.
    """
    own = sites.select(key, "symbol") if weighted else sites.select(key, "symbol").distinct()
    met = own.join(elements, "symbol", "left")
    whole = F.sum("mass")
    return met.groupBy(key).agg(F.when(F.count("price") == F.count("*"), F.sum(F.col("mass") * F.col("price")) / whole).alias("gravimetric"))
