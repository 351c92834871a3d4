"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ORDER bytes. A byte that a context has not shown costs
an escape and is asked of the next shorter context (escape method C, no exclusion), down to a uniform
byte. The statistics are frozen after fitting, so every code length of a seen (context, byte) pair is
worked out once, for all languages side by side, and scoring a text is table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import MULT, pieces

ORDER = 3
#: Labelled documents of a language from which its statistics are taken, about.
FIT_DOCS = 600
#: Languages that are learnt, those with the most labelled documents; so a column of stray labels costs a bounded model.
MOST_LANGS = 200
#: Bytes of text that are coded at once.
SLICE = 1 << 20
PAD = b"\n" * ORDER
GRAMS = "lang string, width int, gram long, n long"


def remainder(mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def packed(held: np.ndarray, width: int) -> np.ndarray:
    """For each byte but the first width - 1 the `width` bytes that end there as one number."""
    code = held[: len(held) - width + 1].astype(np.uint32)
    for j in range(1, width):
        code = (code << np.uint32(8)) | held[j : len(held) - width + 1 + j]
    return code


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by.setdefault(lang, []).append(PAD + text.lower().encode())
        for lang, texts in by.items():
            # Contexts reach back over the padding between texts, never into another text's letters.
            held = np.frombuffer(b"".join(texts), np.uint8)
            for width in range(1, ORDER + 2):
                grams, n = np.unique(packed(held, width), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), width, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "width", "gram", "n"],
                )


class Table:
    """Rows of floats by a 32-bit number, found in a few vectorised probes of an open hash table."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at, self.rows = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), rows
        self.most = 1
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[place] == -1
            _, one = np.unique(place[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.keys[place[won]], self.at[place[won]] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, place = left[rest], (place[rest] + 1) & self.mask
            self.most += bool(len(left))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        place = self._home(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.at[place], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.most):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & self.mask
            held = self.keys[place[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.at[place[open_[same]]]
            open_ = open_[~same & (held != -1)]
        return out


@dataclass
class Model:
    langs: list[str]
    #: For each width from 1 the bits of a gram's last byte after the others, and of an escape from those others.
    cost: list[Table]
    escape: list[Table | None]

    @classmethod
    def fit(cls, grams: pa.Table) -> Model:
        langs = sorted(set(grams.column("lang").to_pylist()))
        lang = np.array([langs.index(x) for x in grams.column("lang").to_pylist()], int)
        width, gram, n = (grams.column(c).to_numpy() for c in ("width", "gram", "n"))
        cost, escape = [], []
        for w in range(1, ORDER + 2):
            of = width == w
            keys, at = np.unique(gram[of], return_inverse=True)
            count = np.zeros((len(keys), len(langs)))
            np.add.at(count, (at, lang[of]), n[of])
            context, to = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(context), len(langs))), np.zeros((len(context), len(langs)))
            np.add.at(total, to, count)
            np.add.at(kinds, to, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                # A context that a language has never seen is passed over at no cost.
                out = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(count / (total + kinds)[to])
            shorter = np.full((len(keys), len(langs)), 8.0) if w == 1 else cost[-1].rows[cost[-1].find(keys & ((1 << 8 * (w - 1)) - 1))]
            cost.append(Table(keys, np.where(count > 0, seen, out[to] + shorter).astype(np.float32)))
            escape.append(Table(context, out.astype(np.float32)))
        return cls(langs, cost, escape)

    def bits(self, held: np.ndarray) -> np.ndarray:
        """The code length of each byte but the first ORDER, by language."""
        code = packed(held, ORDER + 1).astype(np.int64)
        out = np.zeros((len(code), len(self.langs)), np.float32)
        todo = None
        for w in range(ORDER + 1, 0, -1):
            own = code if todo is None else code[todo] & ((1 << 8 * w) - 1)
            row = self.cost[w - 1].find(own)
            here = row >= 0
            at = np.flatnonzero(here) if todo is None else todo[here]
            out[at] += self.cost[w - 1].rows[row[here]]
            todo = np.flatnonzero(~here) if todo is None else todo[~here]
            if not len(todo):
                return out
            context = self.escape[w - 1].find(own[~here] >> 8)
            out[todo[context >= 0]] += self.escape[w - 1].rows[context[context >= 0]]
        out[todo] += 8
        return out

    def total(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text by language. Long ones are coded in slices, each with the ORDER bytes before it."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
                size += len(texts[to]) + ORDER
                to += 1
            if to == at + 1 and size > SLICE:
                held = np.frombuffer(PAD + texts[at], np.uint8)
                for s in range(0, len(held) - ORDER, SLICE):
                    out[at] += self.bits(held[s : s + SLICE + ORDER]).sum(axis=0, dtype=np.float64)
            else:
                parts = [PAD + t for t in texts[at:to]]
                starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
                bits = self.bits(np.frombuffer(b"".join(parts), np.uint8))
                # The padding before a later text codes an end that the text before doesn't have.
                for s in starts[1:]:
                    bits[s - ORDER : s] = 0
                out[at:to] = np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
            at = to
        return out


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """The model of the languages that docs (text, lang) is labelled with, None without any.

    About fit_docs documents of each of the MOST_LANGS languages with the most rows, chosen by a hash of their doc_id over all rows, are
    counted on the executors; what reaches the driver is bounded by them. Null texts and labels teach nothing.
    """
    own = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs / n))])
    drawn = own.where(F.col("lang").isin(*sizes)).where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    grams = drawn.select("text", "lang").mapInArrow(counted, GRAMS).groupBy("lang", "width", "gram").agg(F.sum("n").alias("n")).toArrow()
    return Model.fit(grams) if grams.num_rows else None


def lettered(text: str) -> bool:
    """Whether any character is a letter (Unicode's L); numerals and fractions aren't."""
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) of every row of docs with lang_pred and score; docs needs text.

    lang_pred is the language whose statistics code the whole lower-cased text in the fewest bits, the
    first by name of several; score is its share of the posterior under even odds. `und` with score 0
    stands for a null text, one without a letter, and for a model that has no language. Columns of docs
    named lang_pred and score are replaced. Repeated rows are judged one by one, long texts in slices. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or ["doc_id"] if c not in ("lang_pred", "score")]
    asked = docs.select(*keep, *[c for c in ("text",) if c not in keep])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            real = [i for i, t in enumerate(texts) if known and t and lettered(t)]
            named, score = ["und"] * len(texts), [0.0] * len(texts)
            if real:
                total = known.total([texts[i].lower().encode() for i in real])
                best = total.argmin(axis=1)
                odds = 1 / np.exp2(np.clip(total.min(axis=1, keepdims=True) - total, -1000, 0)).sum(axis=1)
                for i, b, o in zip(real, best, odds):
                    named[i], score[i] = known.langs[b], float(o)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(named, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*(asked.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return asked.mapInArrow(predict, schema)
