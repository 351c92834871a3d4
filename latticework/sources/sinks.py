"""Sinks: nested JSON, CSV in one file or one a key, pages of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_plain(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: _plain(v, kind.valueType))
    return c


def without_nan(df: DataFrame) -> DataFrame:
    """df with null for what isn't a finite number, however deep."""
    return df.select(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_json(df: DataFrame, path: str) -> None:
    without_nan(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One folder of CSV with a head; `by` makes a subfolder for each of its values."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_texts(df: DataFrame, name: str, text: str, path: str) -> None:
    """A subfolder for each name with the text as lines."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
