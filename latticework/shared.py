"""Cutting lineage through the folder that driver and executors share, and ranking without one big task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a private folder is made for a local master; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="latticework-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task of dealt().
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by keys before anything is aggregated or joined by them, into tasks that stay apart.

    Sorted ids take few bytes, so that partitions merged and files read by their bytes hold more rows the more there are.
    """
    return df.repartition(tasks, *keys)


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its rows numbered from 0 in a total order, without a window over all rows.

    Rows are range-partitioned and sorted, written once, and a partition's first number is the sum of the sizes
    before it; only these sizes, one a partition, reach the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    own = written(own, "ranked")
    part = F.shiftright("__at", 33)
    sizes = sorted((r.p, r.n) for r in own.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, base = 0, []
    for p, n in sizes:
        base += [F.lit(p), F.lit(before)]
        before += n
    offset = F.create_map(*base)[part] if base else F.lit(0)
    return own.withColumn(name, (offset + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__at")


def running(df: DataFrame, order: str, *values: str) -> DataFrame:
    """df with rank, from 0, and before_<value>, the sum of a value over the rows before, in the order of a column without equal values.

    As ranked(): sums inside a range's partition, and before it those of the partitions, one row a partition on the driver.
    """
    part = F.shiftright("__at", 33)
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = written(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "running")
    sums = sorted(tuple(r) for r in own.groupBy(part.alias("p")).agg(F.count("*").alias("n"), *[F.sum(v) for v in values]).collect())
    total = [0] * (1 + len(values))
    base: list[list[Column]] = [[] for _ in total]
    for p, *n in sums:
        for i, x in enumerate(n):
            base[i] += [F.lit(p), F.lit(total[i])]
            total[i] += x or 0
    start = lambda i: F.create_map(*base[i])[part] if base[i] else F.lit(0)
    inside = Window.partitionBy(part).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = own.select("*", (start(0) + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long").alias("rank"), *[(start(i) + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"before_{v}") for i, v in enumerate(values, 1)])
    return out.drop("__at")


def quantiles(df: DataFrame, column: str, q: tuple[float, ...]) -> list[float]:
    """Exact quantiles of a column with linear interpolation, over non-null values; nulls if there are none."""
    own = ranked(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), "v")
    n = own.count()
    if not n:
        return [None for _ in q]
    wanted = sorted({int(x) for p in q for x in (p * (n - 1) // 1, -(-(p * (n - 1)) // 1))})
    at = {r["rank"]: r.v for r in own.where(F.col("rank").isin(wanted)).collect()}
    out = []
    for p in q:
        x = p * (n - 1)
        lo, hi = int(x // 1), int(-(-x // 1))
        out.append(at[lo] + (at[hi] - at[lo]) * (x - lo))
    return out
