"""Line deduplication with DataFrame functions only.

Lines are range-partitioned by the hash of their key with a secondary sort by document and position, and
a running first value streams the first document of each hash. Occurrences of a hash are dealt over
slices of the documents first, so that a hot line never meets in one task: a slice drops what isn't of
its own first document, and only the slices' firsts are held against each other. What comes back to a
document is a sparse bitmap of the lines to keep, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import SPACES, unused

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lines of one word of a bitmap.
BITS = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """(id, digest, keep array<long>) of the documents of docs (doc_id, text) that lose lines.

    Bit i of word w tells whether line 64 * w + i stays; a word for every 64 lines, so that a line's is found by its number.
    digest is a hash of the text, which tells rows of the same doc_id apart.
    """
    spark = docs.sparkSession
    slices = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("digest"), split_lines(F.col("text")).alias("lines"))
    lines = own.select("id", "digest", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("id", "digest", "n", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), F.pmod(F.hash("id"), F.lit(slices)).alias("slice"), "id", "digest", "n", "pos")
    first = lambda *by: F.first("id").over(Window.partitionBy(*by).orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = hashed.repartitionByRange("h1", "h2", "slice").withColumn("first", first("h1", "h2", "slice"))
    rest = local.where("id = first").select("h1", "h2", "id", "digest", "n", "pos").repartitionByRange("h1", "h2").withColumn("first", first("h1", "h2"))
    lost = local.where("id > first").select("id", "digest", "n", "pos").union(rest.where("id > first").select("id", "digest", "n", "pos"))
    word = F.floor(F.col("pos") / BITS).alias("word")
    bits = F.expr(f"bit_or(shiftleft(1L, cast(pos % {BITS} as int)))")
    packed = lost.groupBy("id", "digest", "n", word).agg(F.bitwise_not(bits).alias("bits"))
    # Words that lose lines come before the full ones of the same number, which then go.
    some = packed.groupBy("id", "digest", "n").agg(F.collect_list(F.struct("word", F.lit(0).alias("full"), "bits")).alias("some"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BITS)), lambda w: F.struct(w.alias("word"), F.lit(1).alias("full"), F.lit(-1).cast("long").alias("bits")))
    every = some.select("id", "digest", F.array_sort(F.concat("some", full)).alias("every"))
    own_word = F.filter("every", lambda x, i: (i == 0) | (F.get("every", i - 1).getField("word") != x.getField("word")))
    return every.select("id", "digest", F.transform(own_word, lambda x: x.getField("bits")).alias("keep"))


def drop_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """docs (doc_id, text, ...) with text without repeated lines, n_lines before and n_dropped added.

    A line's key is the line without white space at both ends and A-Z lower-cased. A key of at least
    `least` code points that stands in two documents or more keeps its lines in the smallest doc_id
    only, all of them; other lines stay. A null or empty text is one empty line, and comes out empty. Rows
    that share a doc_id are one document. Rows without doc_id are left alone and hold no line. Other
    columns pass through; columns named n_lines and n_dropped are replaced.
    """
    p = unused(docs.columns)
    gone = keep_bitmaps(docs, least).select(F.col("id").alias(p + "id"), F.col("digest").alias(p + "digest"), F.col("keep").alias(p + "keep"))
    own = docs.drop("n_lines", "n_dropped")
    both = own.withColumn(p + "own", F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col(p + "id")) & (F.col(p + "own") == F.col(p + "digest")), "left")
    both = both.withColumn(p + "lines", split_lines(F.col("text")))
    # filter() numbers from 0.
    kept = F.filter(p + "lines", lambda x, i: F.getbit(F.get(p + "keep", F.shiftright(i, 6)), i.bitwiseAND(BITS - 1)) == 1)
    both = both.withColumn(p + "left", F.when(F.col(p + "keep").isNull(), F.col(p + "lines")).otherwise(kept))
    n_lines, n_left = F.size(p + "lines").cast("long"), F.size(p + "left").cast("long")
    names = [F.array_join(p + "left", "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in own.columns]
    return both.select(*names, n_lines.alias("n_lines"), (n_lines - n_left).alias("n_dropped"))
