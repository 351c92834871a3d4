"""What the operators of this package share: table access, the shared folder, words and their hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
#: Spark's own switch for it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where none is set, a private one is made for a local master; a cluster's executors could not see it, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="latticework-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """A job in it drops its shuffle files when it ends; its rows are in a written table by then."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """df cut from its lineage: written to the shared folder as Parquet and read again.

    narrow: the last step of a table that is much smaller than the input takes an eighth of the shuffle's tasks.

    The copy outlives any executor, and what reads it has no inherited partitioning, so that the planner
    deals it anew for a join and may split a hot key.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if narrow:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    with frugal(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `most` bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def unused(columns: list[str], start: str = "__") -> str:
    """A beginning that no column's name has, for columns that come and go."""
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return start


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


#: The bytes with A-Z lower-cased, and those of white space.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
#: What is kept of eight bytes for each number of them.
HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word from which it is hashed by itself.
LONG = 512


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the UTF-8 bytes of all texts, the texts' offsets into them); a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(held: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and end bytes of all words of texts; words don't reach from one text into the next."""
    if not len(held):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~IS_SPACE[held]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = at[(at > 0) & (at < len(held))]
    begins[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashed(held: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each first to its end: eight at a time, mixed after each, so that it is linear in none of them."""
    own = np.concatenate([held, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(held) + 1,), "<u8", own, strides=(1,))
    size = end - first
    out = mix(size.astype(np.uint64) * MULT + MIX1)
    large = np.flatnonzero(size > LONG)
    todo, at = np.flatnonzero(size <= LONG), 0
    while len(todo):
        left = size[todo] - at
        todo, left = (todo, left) if at == 0 else (todo[left > 0], left[left > 0])
        if not len(todo):
            break
        out[todo] = mix((out[todo] ^ (eight[first[todo] + at] & HEADS[np.minimum(left, 8)])) * MULT + MIX2)
        todo, at = todo[left > 8], at + 8
    for i in large.tolist():
        out[i] = xxhash.xxh3_64_intdigest(held[first[i] : end[i]].tobytes())
    return out


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, the texts' offsets into them, the words' first and end bytes in raw(texts)).

    Words are maximal runs without SPACES; a null text has none. lower: A-Z only.
    """
    held, at = raw(texts)
    first, end = bounds(held, at)
    return hashed(LOWER[held] if lower else held, first, end), np.searchsorted(first, at), first, end


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; empty if there are fewer. Doublings put runs together, each mixed."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, width = None, 0, hashes, 1
    while True:
        if k & width:
            out, have = (power[:n], width) if out is None else (mix(out * MULT + power[have : have + n]), have + width)
        if width * 2 > k:
            return out
        power = mix(power[: len(power) - width] * MULT + power[width:])
        width *= 2
