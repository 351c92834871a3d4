"""Packing documents into fixed token windows: concatenate and cut.

First pass: tokenise once, write each document's ids with its offset among its partition's tokens, and
sum the partitions. The totals, one number a partition, become prefix sums. Second pass: a document's
offset among all tokens is its partition's plus its own; the fixed windows that it crosses cut it, and
each cut is recorded as a piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm.common import IS_SPACE, bounds, pieces, raw, written

WINDOW = 2048
END_ID = 1
TOKENS = "doc_id long, ids binary, n long, part long, at long"
PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Distinct words whose ids a task keeps.
KEPT_WORDS = 500_000
#: What parts the words of a line that are encoded together, and how many they are.
PART, LINE = "7", 500
IS_MARK, IS_LETTER = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_known: dict[str, WordTokenizer] = {}


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """A tokenizer whose ids for a text are those of its words one after the other.

    This holds for vocabularies that drop white space before they merge, as the default one does. Each
    distinct word is encoded once for many texts, and found again by its spelling.
    """

    def __init__(self, path: str) -> None:
        self.own = Tokenizer.from_file(path)
        self.type = np.uint16 if self.own.get_vocab_size() <= 1 << 16 else np.uint32
        # A sign that is a token of its own wherever it stands parts the words of a line.
        alone = self.own.encode(f"a {PART} a", add_special_tokens=False).ids
        self.part = alone[1] if len(alone) == 3 else None
        # Of a vocabulary that marks the ends of words, the ids that end one.
        suffix = getattr(self.own.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.own.get_vocab_size(), bool)
        if suffix:
            self.last[[i for t, i in self.own.get_vocab().items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.size, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.type), 0

    def one_by_one(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.own.encode_batch_fast(spelled, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), self.type), np.array([len(x) for x in found], np.int64)

    def several(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words, how many each has)."""
        ids, sizes = [], []
        for at in range(0, len(spelled), LINE):
            words_ = spelled[at : at + LINE]
            if all(map(str.isalpha, words_)):
                # Each has an end of its own, if there are as many ends as words.
                found = np.array(self.own.encode_batch_fast([" ".join(words_)], add_special_tokens=False)[0].ids, np.int64)
                cut = np.flatnonzero(self.last[found])
                if len(cut) == len(words_) and cut[-1] == len(found) - 1:
                    ids.append(found.astype(self.type))
                    sizes.append(np.diff(np.concatenate([[-1], cut])))
                    continue
            line = f" {PART} ".join(words_)
            if self.part is not None and line.count(PART) == len(words_) - 1:
                found = np.array(self.own.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
                cut = np.flatnonzero(found == self.part)
                if len(cut) == len(words_) - 1:
                    ids.append(np.delete(found, cut).astype(self.type))
                    sizes.append(np.diff(np.concatenate([[-1], cut, [len(found)]])) - 1)
                    continue
            a, b = self.one_by_one(words_)
            ids.append(a)
            sizes.append(b)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, spelled: list[str]) -> None:
        # Words of letters go first; those with the parting sign go last, so that few lines have any.
        spelled = sorted(spelled, key=lambda x: 0 if x.isalpha() else 1 + (PART in x))
        found, sizes = self.several(spelled)
        n, more = len(self.at), len(found)
        while n + len(sizes) > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + more] = found
        self.first[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(sizes)] = sizes
        self.at.update(zip(spelled, range(n, n + len(sizes))))
        self.used += more

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        held, at = raw(texts)
        first, end = bounds(held, at)
        if len(first):
            # A mark right behind a letter of A-Z is a token of its own.
            marked = np.flatnonzero((end - first > 1) & IS_MARK[held[end - 1]] & IS_LETTER[held[end - 2]])
            first, end = np.insert(first, marked + 1, end[marked] - 1), np.insert(end, marked, end[marked] - 1)
        # The words as they are spelled, one behind the other: equal ones are found by their bytes.
        solid = held[~IS_SPACE[held]]
        stops = np.concatenate([[0], np.cumsum(end - first)])
        spelled = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(solid)).dictionary_encode()
        names, of = spelled.dictionary.to_pylist(), spelled.indices.to_numpy(zero_copy_only=False)
        if len(self.at) + len(names) > KEPT_WORDS:
            self.forget()
        row = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(row < 0).tolist()
        if new:
            self.learn([names[i] for i in new])
            row[new] = [self.at[names[i]] for i in new]
        row = row[of]
        sizes = self.size[row]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.first[row] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bound = np.concatenate([[0], ends])[np.searchsorted(first, at)]
        return [ids[s:e] for s, e in zip(bound[:-1], bound[1:])]


def known(path: str) -> WordTokenizer:
    if path not in _known:
        _known[path] = WordTokenizer(path)
    return _known[path]


def tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps its words from task to task.
        tokenizer, at, part = known(path), 0, TaskContext.get().partitionId()
        last = np.array([end_id], tokenizer.type)
        for batch in pieces(batches, "text"):
            found = [np.concatenate([x, last]) for x in tokenizer.encode(batch.column("text"))]
            sizes = np.array([len(x) for x in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(sizes), pa.array(np.full(len(found), part, np.int64)), pa.array(at + np.cumsum(sizes) - sizes)],
                names=["doc_id", "ids", "n", "part", "at"],
            )
            at += int(sizes.sum())

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs (doc_id, text), each with its ids, in sequences of `window` tokens.

    A document is its text's ids and end_id; a null or empty text is end_id alone. Every id is in one
    piece. All sequences are full but the last. Rows with the same or a null doc_id are packed one by one.
    ids are unsigned 32-bit little-endian. Other columns are ignored; no row gives no piece.
    """
    path = tokenizer or default_tokenizer()
    tokens = written(docs.select("doc_id", "text").mapInArrow(tokenised(path, end_id), TOKENS), "tokens")
    # One number for each partition of the first pass.
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())
    before, base = 0, {}
    for part, total in totals:
        base[part] = before
        before += total
    wide = Tokenizer.from_file(path).get_vocab_size() > 1 << 16

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids"):
            out: list[list] = [[] for _ in range(8)]
            for doc, ids, n, part, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "part", "at"))):
                here, own = base[part] + at, np.frombuffer(ids, np.uint32 if wide else np.uint16).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(here + start, window)
                    length = min(n - start, window - offset)
                    piece = own[start : start + length].tobytes()
                    for column, value in zip(out, (doc, start, length, piece, zlib.crc32(piece), n, sequence, offset)):
                        column.append(value)
                    start += length
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.mapInArrow(cut, PIECES)
