"""Removal of long passages that an earlier document has, by compaction of a de Bruijn graph of tokens.

An edge of the graph is a token k-mer: the `span` words of a window, between the nodes of its first and last span - 1
words. A filter that loses no equal windows comes first: of the seeds (short runs of words) in a window the one with the smallest
hash stands for it, equal windows have equal seeds, and windows whose seed one document alone has make no edge.

The edges that two documents or more have are joined with their only successor, where that has no other
predecessor: such a chain is a nonbranching path, and every document that passes through one of its edges
passes through all. So a path is compacted to its two ends. Ends go back to the documents, whose source
coordinates pair them into spans; a span is as long as its path. The smallest document of a path gives a
digest of the words at its coordinates, and every later span is held against it before its words go.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import forget, pieces, raw, rolled, words, written

SPAN, SEED = 50, 16
SEEDS = "seed long, doc long, spot long, n long"
RUNS = "doc long, spot long, before long, edges array<long>, after long"
DIGESTS = "path long, digest binary"
KEPT = "doc_id long, n_words long, n_removed long, text string"
#: What stands before a document's first edge and after its last.
NOTHING = 0
#: The place of a word in a spot, below the text's checksum, which tells rows of one doc_id apart.
PLACE = (1 << 31) - 1


def row_of(held: np.ndarray, bytes_at: np.ndarray, i: int) -> int:
    return zlib.crc32(held[bytes_at[i] : bytes_at[i + 1]]) << 31


def seeds(span: int, k: int):
    """The seed of each run of neighbouring windows that share one, with the run's first window and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, at, _, _ = words(batch.column("text"))
            held, bytes_at = raw(batch.column("text"))
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = hashes[at[i] : at[i + 1]]
                if doc is None or len(own) < span:
                    continue
                short = np.lib.stride_tricks.sliding_window_view(rolled(own, k), span - k + 1).min(axis=1)
                begin = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
                size = np.diff(np.concatenate([begin, [len(short)]]))
                for column, x in zip(columns, (short[begin].view(np.int64), np.full(len(begin), doc, np.int64), begin + row_of(held, bytes_at, i), size)):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["seed", "doc", "spot", "n"])

    return run


def runs_of(marks: list[dict], row: int, most: int) -> list[tuple[int, int]]:
    """(first window, behind the last) of the runs that the marks of one text cover together."""
    own = sorted({(m["spot"] & PLACE, m["n"]) for m in marks if m["spot"] - (m["spot"] & PLACE) == row})
    out: list[tuple[int, int]] = []
    for begin, n in own:
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], min(most, begin + n)))
        else:
            out.append((begin, min(most, begin + n)))
    return out


def edges(span: int):
    """The edges of each text where it may repeat, as arrays of neighbours, with the edges before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, at, _, _ = words(batch.column("text"))
            held, bytes_at = raw(batch.column("text"))
            rows: list[tuple] = []
            for i, (doc, marks) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("marks").to_pylist())):
                row, own = row_of(held, bytes_at, i), rolled(hashes[at[i] : at[i + 1]], span).view(np.int64)
                for begin, end in runs_of(marks, row, len(own)):
                    rows.append((doc, begin + row, own[begin - 1] if begin else NOTHING, own[begin:end], own[end] if end < len(own) else NOTHING))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["doc", "spot", "before", "edges", "after"])

    return run


def spans_of(ends: list[dict], row: int) -> list[tuple[dict, int]]:
    """(first end, windows) of the paths that one text passes: its ends in their order, each first one with the next last one."""
    own = {m["spot"]: m for m in ends if m["spot"] - (m["spot"] & PLACE) == row}
    first = sorted(s for s in own if own[s]["first"])
    last = sorted(s for s in own if own[s]["last"])
    behind = [bisect_left(last, s) for s in first]
    return [(own[s], last[j] - s + 1) for s, j in zip(first, behind) if j < len(last)]


def digest(held: np.ndarray, first: np.ndarray, end: np.ndarray) -> bytes:
    """A digest of words."""
    return hashlib.blake2b(b" ".join(held[s:e].tobytes() for s, e in zip(first.tolist(), end.tolist())), digest_size=20).digest()


def first_words(span: int):
    """The digest of each path's words at its source coordinates, from the smallest document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            _, at, first, end = words(batch.column("text"))
            held, bytes_at = raw(batch.column("text"))
            found: dict[int, bytes] = {}
            for i, (doc, ends) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("ends").to_pylist())):
                for m, n in spans_of(ends, row_of(held, bytes_at, i)):
                    if m["lo"] == doc and m["edge"] not in found:
                        s = at[i] + (m["spot"] & PLACE)
                        found[m["edge"]] = digest(held, first[s : s + n + span - 1], end[s : s + n + span - 1])
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["path", "digest"])

    return run


def without(span: int):
    """The texts less the spans whose words are those of their paths' first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            _, at, first, end = words(batch.column("text"))
            held, bytes_at = raw(batch.column("text"))
            sizes, gone, left = np.diff(at), [], []
            for i, cuts in enumerate(batch.column("cuts").to_pylist()):
                row = row_of(held, bytes_at, i) if cuts else 0
                lost = np.zeros(sizes[i] + 1, np.int64)
                own = {m["spot"]: m for m in cuts or () if m["spot"] - (m["spot"] & PLACE) == row}
                for m in own.values():
                    begin, n = m["spot"] & PLACE, m["n"] + span - 1
                    if digest(held, first[at[i] + begin : at[i] + begin + n], end[at[i] + begin : at[i] + begin + n]) == m["digest"]:
                        lost[begin] += 1
                        lost[begin + n] -= 1
                keep = np.flatnonzero(np.cumsum(lost[:-1]) == 0) + at[i]
                gone.append(int(sizes[i] - len(keep)))
                left.append(b" ".join(held[s:e].tobytes() for s, e in zip(first[keep].tolist(), end[keep].tolist())).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "text"]
            )

    return run


def late_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of a document that an earlier one has: (doc, path, spot, n)."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, ends in zip(batch.column("doc").to_pylist(), batch.column("ends").to_pylist()):
            for row in {m["spot"] - (m["spot"] & PLACE) for m in ends}:
                rows += [(doc, m["edge"], m["spot"], n) for m, n in spans_of(ends, row) if m["lo"] < doc]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc", "path", "spot", "n"])


def drop_repeated_passages(docs: DataFrame, span: int = SPAN, k: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for every row of docs (doc_id, text).

    text is the row's words (maximal runs without white space, unchanged) joined by one space, without those
    that a window of `span` words covers whose words also start in a document with a smaller doc_id, as the
    input has it. Null and empty texts have no words. Rows with the same doc_id are one document and keep
    what they share. Rows without doc_id stay whole and take nothing from others. Other columns are ignored. A text
    of 2 to the 31 words or more is beyond the coordinates. k is the length of the seeds of the filter and changes no result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = written(source.mapInArrow(seeds(span, k), SEEDS), "seeds")
    shared = written(own.groupBy(F.col("seed").alias("s")).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("s"), "shared")
    marks = own.join(shared, F.col("seed") == F.col("s"), "left_semi").select("doc", "spot", "n")
    marks = written(marks.groupBy("doc").agg(F.collect_list(F.struct("spot", "n")).alias("marks")), "marks")
    forget(own, shared)
    texts = source.select(F.col("doc_id").alias("t"), "text")
    runs = written(marks.join(texts, F.col("doc") == F.col("t")).select("doc", "marks", "text").mapInArrow(edges(span), RUNS), "runs")
    forget(marks)
    near = lambda i, other: F.coalesce(F.get("edges", i), F.col(other))
    each = runs.select("doc", F.explode(F.transform("edges", lambda e, i: F.struct(e.alias("edge"), near(i - 1, "before").alias("prev"), near(i + 1, "after").alias("next")))).alias("x")).select("doc", "x.*")
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != NOTHING), F.min(c)).alias(c)
    graph = each.groupBy("edge").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), only("prev"), only("next")).where("lo < hi").select("edge", "lo", "prev", "next")
    graph = written(graph, "graph")
    # A link is where an edge's only successor has it as its only predecessor; without one a path begins or ends.
    there = graph.select(F.col("edge").alias("n_edge"), F.col("prev").alias("n_prev"))
    back = graph.select(F.col("edge").alias("p_edge"), F.col("next").alias("p_next"))
    # Edges without a neighbour have their own key, or they would all meet in one task.
    dealt = lambda c: F.coalesce(c, "edge")
    linked = graph.join(there, (dealt("next") == F.col("n_edge")) & (F.col("edge") == F.col("n_prev")) & F.col("next").isNotNull(), "left").select("edge", "lo", "prev", F.col("n_edge").isNull().alias("last"))
    linked = linked.join(back, (dealt("prev") == F.col("p_edge")) & (F.col("edge") == F.col("p_next")) & F.col("prev").isNotNull(), "left").select(F.col("edge").alias("e"), "lo", F.col("p_edge").isNull().alias("first"), "last")
    tips = written(linked.where("first or last"), "tips")
    forget(graph)
    placed = runs.select("doc", "spot", F.posexplode("edges").alias("i", "edge")).select("doc", (F.col("spot") + F.col("i")).alias("spot"), "edge")
    ends = written(placed.join(tips, F.col("edge") == F.col("e")).select("doc", "spot", "edge", "lo", "first", "last"), "ends")
    forget(runs, tips)
    # So many tasks as that, for rows that cost more than their bytes.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = written(ends.repartition(parts, "doc").groupBy("doc").agg(F.collect_list(F.struct("spot", "edge", "lo", "first", "last")).alias("ends")), "paths")
    holders = ends.where(F.exists("ends", lambda m: m.getField("lo") == F.col("doc")))
    digests = holders.join(texts, F.col("doc") == F.col("t")).select("doc", "ends", "text").mapInArrow(first_words(span), DIGESTS)
    digests = written(digests.groupBy(F.col("path").alias("d")).agg(F.min("digest").alias("digest")), "digests")
    late = written(ends.mapInArrow(late_spans, "doc long, path long, spot long, n long"), "late")
    cuts = late.join(digests, F.col("path") == F.col("d")).select("doc", "spot", "n", "digest")
    cuts = written(cuts.groupBy(F.col("doc").alias("c")).agg(F.collect_list(F.struct("spot", "n", "digest")).alias("cuts")), "cuts")
    forget(ends, digests, late)
    return source.join(cuts, F.col("doc_id") == F.col("c"), "left").select("doc_id", "text", "cuts").mapInArrow(without(span), KEPT)
