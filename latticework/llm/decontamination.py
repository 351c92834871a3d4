"""Benchmark decontamination by q-gram lemma filtering.

A text that lies within `edits` edits of an item of n characters shares n + 1 - q * (edits + 1) of its
character q-grams, all of them on neighbouring diagonals. Hits are counted in diagonal bands that
overlap by half, so that one of them holds them all; a place of the text counts once in a band for each run of the item's
places of its q-gram, so that repeated q-grams don't multiply. Bands under the bound are dropped, and the
regions that are left are aligned with the item cell by cell of their band alone, one row at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import MULT, pieces, unused, written

Q = 8
#: Edits for each hundred characters of an item.
EDIT_PERCENT = 10
#: Bytes of items, about, that are held against a batch of texts at once; an index has about 30 times as many.
BLOCK_BYTES = 1 << 20
#: Bytes of a text that are searched at once.
SLICE = 1 << 19
FOUND = "doc_id long, item_id long, start long, end long, edits long, item_chars long, regions long"
INFINITE = np.int64(1) << 60
ONE = np.int64(1) << 32


def plain(text: str | None) -> bytes:
    """Words lower-cased in A-Z and joined by one space."""
    return b" ".join(text.encode().lower().split()) if text else b""


def codes(held: np.ndarray) -> np.ndarray:
    """The Q bytes from each position as one number."""
    two = (held[:-1].astype(np.uint16) << np.uint16(8)) | held[1:]
    four = (two[:-2].astype(np.uint32) << np.uint32(16)) | two[2:]
    return (four[:-4].astype(np.uint64) << np.uint64(32)) | four[4:]


def budget(n: int, percent: int) -> int:
    """Edits that an item of n bytes may have, fewer where the lemma would ask for no shared q-gram."""
    return max(0, min(n * percent // 100, n // Q - 1))


class Items:
    """A block of items and where their q-grams stand: runs of places no farther apart than a band is wide."""

    def __init__(self, rows: list[tuple[int, bytes]], percent: int) -> None:
        self.rows = [(i, t) for i, t in rows if len(t) >= Q]
        size = np.array([len(t) for _, t in self.rows], np.int64)
        self.edits = np.array([budget(n, percent) for n in size], np.int64)
        self.least = size + 1 - Q * (self.edits + 1)
        self.longest = int((size + self.edits).max()) if len(size) else 0
        gram = [codes(np.frombuffer(t, np.uint8)) for _, t in self.rows]
        item = np.repeat(np.arange(len(gram)), [len(g) for g in gram])
        place = np.concatenate([np.arange(len(g)) for g in gram]) if gram else np.empty(0, np.int64)
        flat = np.concatenate(gram) if gram else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, item, place = flat[order], item[order], place[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.edits[item[1:]] + 1)
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(flat)]]) - 1
        self.item, self.low, self.high = item[begin].astype(np.int32), place[begin].astype(np.int32), place[end[: len(begin)]].astype(np.int32)
        self.keys, first, count = np.unique(flat[begin], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        self.bits = np.uint64(64 - 22)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys * MULT) >> self.bits] = True


def aligned(item: bytes, region: bytes, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of region nearest to item on the diagonals low to high, None beyond `most` edits.

    Diagonal d has byte i + d of the region against byte i of the item. A row holds for each diagonal the fewest edits and, with them,
    where the part begins; the row before is all that is kept.
    """
    own, n, m, wide = np.frombuffer(item, np.uint8), len(item), len(region), high - low + 1
    left = max(0, -low) + 1
    text = np.full(left + max(m, n + high) + 1, -1, np.int16)
    text[left : left + m] = np.frombuffer(region, np.uint8)
    steps = np.arange(wide, dtype=np.int64) * ONE
    row = np.arange(low, high + 1, dtype=np.int64)
    row[(row < 0) | (row > m)] = INFINITE
    for i in range(1, n + 1):
        at = left + i - 1 + low
        new = row + (text[at : at + wide] != own[i - 1]) * ONE
        np.minimum(new[:-1], row[1:] + ONE, out=new[:-1])
        outside = max(0, -i - low)
        new[:outside] = INFINITE
        new[max(0, m - i - low + 1) :] = INFINITE
        row = np.minimum.accumulate(new - steps) + steps
        row[:outside] = INFINITE
        row[max(0, m - i - low + 1) :] = INFINITE
        if row.min() >> 32 > most:
            return None
    best = int(row.argmin())
    return int(row[best] >> 32), int(row[best] & (ONE - 1)), n + low + best


def bands(texts: list[bytes], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, band, hits) of every diagonal band that meets its item's bound: band b has the diagonals from b * (edits + 1) on, twice as many."""
    slices = [(d, s, t[s : s + SLICE + items.longest]) for d, t in enumerate(texts) for s in range(0, max(1, len(t)), SLICE)]
    at = 0
    seen: dict[tuple[int, int, int], int] = {}
    while at < len(slices):
        # As many slices as make up the size of one, the last of a text with what overlaps.
        size, to = 0, at
        while to < len(slices) and (to == at or size + len(slices[to][2]) <= SLICE + items.longest):
            size += len(slices[to][2])
            to += 1
        for d, i, b, n in met(slices[at:to], items):
            seen[d, i, b] = max(n, seen.get((d, i, b), 0))
        at = to
    yield from ((*k, n) for k, n in sorted(seen.items()))


def met(slices: list[tuple[int, int, bytes]], items: Items) -> Iterator[tuple[int, int, int, int]]:
    held = np.frombuffer(b"".join(t + b"\0" * Q for _, _, t in slices), np.uint8)
    base = np.cumsum([0] + [len(t) + Q for _, _, t in slices])
    gram = codes(held)
    at = np.flatnonzero(items.maybe[(gram * MULT) >> items.bits])
    slot = np.searchsorted(items.keys, gram[at])
    slot[slot == len(items.keys)] = 0
    true = items.keys[slot] == gram[at]
    at, slot = at[true], slot[true]
    n = items.count[slot].astype(np.int64)
    run = np.repeat(items.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at, item = np.repeat(at, n), items.item[run].astype(np.int64)
    own = np.searchsorted(base, at, side="right") - 1
    pair = own * len(items.rows) + item
    # A slice with fewer hits in all than the bound can't reach it in a band.
    kinds, of, total = np.unique(pair, return_inverse=True, return_counts=True)
    enough = (total >= items.least[kinds % len(items.rows)])[of]
    if not enough.any():
        return
    at, item, own, pair, run = at[enough], item[enough], own[enough], pair[enough], run[enough]
    stride = items.edits[item] + 1
    place = at - base[own] + np.array([s for _, s, _ in slices])[own]
    first, last = (place - items.high[run]) // stride - 1, (place - items.low[run]) // stride
    # A place opens its bands and closes them behind the last; sums of these are the hits of a band.
    shift, wide = -int(first.min()), int(last.max() - first.min()) + 3
    key = pair * wide + shift
    edge, to = np.unique(np.concatenate([key + first, key + last + 1]), return_inverse=True)
    hits = np.cumsum(np.bincount(to[: len(first)], minlength=len(edge)) - np.bincount(to[len(first) :], minlength=len(edge)))
    good = np.flatnonzero(hits >= items.least[edge // wide % len(items.rows)])
    for j in good.tolist():
        d, i = divmod(int(edge[j]) // wide, len(items.rows))
        for b in range(int(edge[j]) % wide - shift, int(edge[j + 1]) % wide - shift):
            yield slices[d][0], i, b, int(hits[j])


def search(texts: list[bytes], items: Items) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(text's number, item id, start, end, edits, item's bytes, regions) of each item that a text holds."""
    if not len(items.keys):
        return
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, i, b, n in bands(texts, items):
        by.setdefault((d, i), []).append((-n, b))
    for (d, i), own in by.items():
        name, item = items.rows[i]
        e, best, tried = int(items.edits[i]), None, {}
        here = texts[d].find(item)
        if here >= 0:
            best = (0, here, here + len(item))
        for n, b in sorted(own):
            # So many edits at least: each undoes Q q-grams at most.
            if best and best[0] <= -(-(len(item) - Q + 1 + n) // Q):
                break
            low = b * (e + 1) - e
            start = max(0, low)
            region = texts[d][start : max(0, low + 2 * (e + 1) + len(item) + 2 * e)]
            if (low - start, region) not in tried:
                tried[low - start, region] = aligned(item, region, e, low - start, low - start + 2 * (e + 1) + 2 * e)
            found = tried[low - start, region]
            if found and (best is None or found[0] < best[0]):
                best = (found[0], start + found[1], start + found[2])
        if best:
            yield d, name, best[1], best[2], best[0], len(item), len(own)


def indexed(benchmark: DataFrame, percent: int, most: int) -> DataFrame:
    """(block, index): the items in blocks of about `most` bytes, each with its index, made by the executors and written."""
    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-total // most) or 1)).cast("int"))

    def index(key: tuple, rows: pa.Table) -> pa.Table:
        made = Items(list(zip(rows.column("item_id").to_pylist(), map(plain, rows.column("text").to_pylist()))), percent)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(made)], pa.binary())})

    return written(own.groupBy("block").applyInArrow(index, "block int, index binary"), "benchmark")


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits, item_chars, regions): one row for each item that a document holds.

    docs has doc_id and text, benchmark item_id and text. Both are compared with words lower-cased in A-Z and joined by one
    space, in bytes of UTF-8; start and end are such bytes of the whole text's nearest region, regions counts
    the diagonal bands that meet the bound. edits is at most edit_percent of an item's length, and under its
    length / 8. Items of fewer than 8 such bytes, null and empty ones are not looked for; null and empty
    texts hold none. Rows with the same or a null doc_id, and items of one item_id, are searched one by one.
    Long texts are searched in overlapping slices. Items come in blocks of bounded size whose indexes the executors make; each is broadcast
    by itself, and one pass over the documents holds every batch against one block after the other, with no shuffle.
    """
    blocks = indexed(benchmark, edit_percent, block_bytes)
    names = sorted(r.block for r in blocks.select("block").collect())
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(bytes(blocks.where(F.col("block") == b).select("index").first()[0])) for b in names]

    def opened() -> Iterator[Items]:
        # Of several blocks a worker holds one at a time.
        for b in shared:
            yield pickle.loads(b.value if len(shared) == 1 else b.load_from_path(b._path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = list(opened()) if len(shared) == 1 else None
        for batch in pieces(batches, "text", SLICE if only else 8 * SLICE):
            texts = [plain(t) for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            for items in only or opened():
                found = list(search(texts, items))
                columns = [[ids[r[0]] for r in found]] + [[r[c] for r in found] for c in range(1, 7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits", "item_chars", "regions"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT) -> DataFrame:
    """The rows of docs that hold no item; rows of a doc_id go together, those without one stay."""
    name = unused(docs.columns) + "bad"
    bad = contaminated(docs, benchmark, edit_percent).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(name), "left_anti")
