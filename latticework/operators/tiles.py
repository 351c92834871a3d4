"""Work on all pairs of a group without rows for pairs: blocks of a group's rows meet in tiles, and a tile leaves only its sums.

The work is that of all pairs and grows with the square of a group. What is sent grows with that square over BLOCK, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows of a block, and the part of a tile that is looked at together, which fits a core's cache.
BLOCK, ROWS, COLUMNS = 8192, 128, 2048
#: How near a distance may come to a limit before it is taken from the differences of the numbers themselves.
NEAR = 1e-8


@dataclass
class Block:
    """Rows of one side of a tile in the order of their keys. code: in the order of the keys, equal for equal ones; x: a row's numbers, None if one is null; columns: null is NaN."""

    keys: pa.Array
    code: np.ndarray
    x: list[np.ndarray | None]
    columns: dict[str, np.ndarray]

    def __len__(self) -> int:
        return len(self.code)


Fold = Callable[[Block, Block, bool], dict]


def tiles(points: DataFrame, group: str, key: str, vector: str, fold: Fold, fields: str, role: tuple[Column, Column] | None = None, columns: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """(group, fields): what fold makes of each tile: its two blocks, and whether they are the same one.

    Each two rows of a group meet in one tile, those of equal keys in a tile of one block. With role = (first filter, second filter) every row of the
    first kind meets every one of the second. Rows without a group or key meet none. KEY in fields is the key's type.
    """
    spark, rows = points.sparkSession, block or BLOCK
    own = points.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    own = own.select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.col(vector).alias("__v"), *[F.col(c).cast("double").alias(c) for c in columns], *[F.coalesce(f, F.lit(False)).alias(f"__r{i}") for i, f in enumerate(role or ())])
    # Groups of more than one block are few: there are at most as many of them as blocks, so that they can be sent to all.
    many = [F.count("*")] * 2 if role is None else [F.count_if(F.col(f"__r{i}")) for i in (0, 1)]
    large = own.groupBy(F.col("__g").alias("__l")).agg(*[F.greatest(F.ceil(n / rows), F.lit(1)).cast("int").alias(f"__n{i}") for i, n in enumerate(many)]).where("__n0 > 1 or __n1 > 1")
    own = own.join(F.broadcast(large), F.col("__g") == F.col("__l"), "left")
    size = [F.coalesce(f"__n{i}", F.lit(1)) for i in (0, 1)]
    at = [F.pmod(F.xxhash64("__k"), n).cast("int") for n in size]
    every = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    if role is None:
        sent = F.transform(every(size[0]), lambda i: F.when(i < at[0], tile(i, at[0], 1)).otherwise(tile(at[0], i, 0)))
    else:
        none = F.array().cast("array<struct<x:int,y:int,side:int>>")
        sent = F.concat(F.when(F.col("__r0"), F.transform(every(size[1]), lambda i: tile(at[0], i, 0))).otherwise(none), F.when(F.col("__r1"), F.transform(every(size[0]), lambda i: tile(i, at[1], 1))).otherwise(none))
    own = own.select("__g", "__k", "__v", *columns, F.explode(sent).alias("__t")).select("__g", "__k", "__v", *columns, F.col("__t.x").alias("__x"), F.col("__t.y").alias("__y"), F.col("__t.side").alias("__s"))
    kind = {c: own.schema[c].dataType.simpleString() for c in ("__g", "__k")}
    schema = StructType.fromDDL(f"`{group}` {kind['__g']}, {fields.replace('KEY', kind['__k'])}")
    shape, within = to_arrow_schema(schema), role is None

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = table.column("__k").combine_chunks().dictionary_encode()
        rank = np.empty(len(keys.dictionary), np.int64)
        rank[pc.sort_indices(keys.dictionary).to_numpy()] = np.arange(len(rank))
        code, side = rank[keys.indices.to_numpy()], table.column("__s").to_numpy()
        same = within and table.column("__x")[0].as_py() == table.column("__y")[0].as_py()
        take = lambda rows: _block(table, code, rows[np.argsort(code[rows], kind="stable")], columns)
        a = take(np.arange(len(side)) if same else np.flatnonzero(side == 0))
        b = a if same else take(np.flatnonzero(side == 1))
        made = fold(a, b, same) if len(a) and len(b) else {}
        if not made:
            return shape.empty_table()
        n = len(next(iter(made.values())))
        made[group] = pa.repeat(table.column("__g")[0], n)
        return pa.table([pa.array(made[f.name], f.type) if not isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else made[f.name].cast(f.type) for f in shape], schema=shape)

    # As many partitions as are asked for, whatever their bytes: what a tile costs isn't seen from its size.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return own.repartition(parts, "__g", "__x", "__y").groupBy("__g", "__x", "__y").applyInArrow(run, schema)


def _block(table: pa.Table, code: np.ndarray, rows: np.ndarray, columns: tuple[str, ...]) -> Block:
    some = table.take(pa.array(rows))
    vectors = some.column("__v").combine_chunks()
    flat, ends = vectors.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))])
    numbers = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)
    known = ~pc.is_null(vectors).to_numpy(zero_copy_only=False)
    if flat.null_count:
        null = np.concatenate([[0], np.cumsum(pc.is_null(flat).to_numpy(zero_copy_only=False))])
        known &= null[ends[1:]] == null[ends[:-1]]
    x = [numbers[s:e] if ok else None for s, e, ok in zip(ends[:-1], ends[1:], known)]
    return Block(some.column("__k").combine_chunks(), code[rows], x, {c: pc.cast(some.column(c), pa.float64()).to_numpy() for c in columns})


def pairs_of(a: Block, b: Block, same: bool) -> int:
    """How many pairs a tile has, those without a distance included."""
    if not same:
        return len(a) * len(b)
    return (len(a) ** 2 - int((np.unique(a.code, return_counts=True)[1].astype(np.int64) ** 2).sum())) // 2


class Vectors:
    """Euclidean distances of rows x to rows y: from products where all numbers are tame, and always from the differences where it counts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, tame: bool):
        self.x, self.y, self.tame = x, y, tame
        if tame:
            centre = np.concatenate([x, y]).mean(axis=0)
            p, q = x - centre, y - centre
            one = lambda n: np.ones((n, 1))
            self.p2, self.q2 = (p * p).sum(axis=1, keepdims=True), (q * q).sum(axis=1, keepdims=True)
            self.p, self.q = np.hstack([-2 * p, self.p2, one(len(p))]), np.ascontiguousarray(np.hstack([q, one(len(q)), self.q2]).T)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for c in range(self.x.shape[1]):
                d = self.x[i, c] - self.y[j, c]
                total += d * d
        return np.sqrt(total)

    def between(self, rows: slice, cols: slice, near: Callable[[np.ndarray], np.ndarray] | None) -> np.ndarray:
        if not self.tame:
            i, j = np.meshgrid(np.arange(rows.start, rows.stop), np.arange(cols.start, cols.stop), indexing="ij")
            return self.exact(i.ravel(), j.ravel()).reshape(i.shape)
        d = self.p[rows] @ self.q[:, cols]
        low = d < 1e-6 * (self.p2[rows].max() + self.q2[cols].max())
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        return repaired(d, self, rows, cols, low, near)


def repaired(d: np.ndarray, measure, rows: slice, cols: slice, low: np.ndarray | None, near: Callable[[np.ndarray], np.ndarray] | None) -> np.ndarray:
    wrong = near(d) if near else None
    wrong = low if wrong is None else wrong if low is None else wrong | low
    if wrong is not None and wrong.any():
        i, j = np.nonzero(wrong)
        for s in range(0, len(i), 1 << 16):
            e = slice(s, s + (1 << 16))
            d[i[e], j[e]] = measure.exact(rows.start + i[e], cols.start + j[e])
    return d


def _kinds(block: Block) -> dict[tuple[int, bool], np.ndarray]:
    """Rows by how many numbers they have and whether all are finite and of a size whose square is."""
    out: dict[tuple[int, bool], list[int]] = {}
    for r, x in enumerate(block.x):
        if x is not None:
            out.setdefault((len(x), bool((np.abs(x) < 1e150).all())), []).append(r)
    return {k: np.array(v) for k, v in out.items()}


def measured(a: Block, b: Block) -> Iterator[tuple[np.ndarray, np.ndarray, Vectors]]:
    """Rows of a, rows of b and the distances between them, for all that have one."""
    ka, kb = _kinds(a), _kinds(b)
    for (n, tame), i in ka.items():
        for (m, other), j in kb.items():
            if n == m:
                yield i, j, Vectors(np.stack([a.x[r] for r in i]), np.stack([b.x[r] for r in j]), tame and other)


def chunks(a: Block, b: Block, same: bool, measure=measured, near: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(rows of a, rows of b, their distances, which of these count or None for all): every pair of a tile once."""
    for i, j, m in measure(a, b):
        for r in range(0, len(i), ROWS):
            rows = slice(r, min(r + ROWS, len(i)))
            for c in range(0, len(j), COLUMNS):
                cols = slice(c, min(c + COLUMNS, len(j)))
                mask = None
                if same:
                    x, y = a.code[i[rows]], b.code[j[cols]]
                    if y[-1] <= x[0]:
                        continue
                    if y[0] <= x[-1]:
                        mask = x[:, None] < y[None, :]
                yield i[rows], j[cols], m.between(rows, cols, near), mask


def near_limits(*limits: float) -> Callable[[np.ndarray], np.ndarray]:
    def near(d: np.ndarray) -> np.ndarray:
        out = np.abs(d - limits[0]) < NEAR
        for x in limits[1:]:
            out |= np.abs(d - x) < NEAR
        return out

    return near


def near_steps(low: float, width: float) -> Callable[[np.ndarray], np.ndarray]:
    def near(d: np.ndarray) -> np.ndarray:
        q = d - low
        q /= width
        q -= np.rint(q)
        return np.abs(q, out=q) < NEAR * (1 + 1 / width)

    return near


# Plain twins of the combiners of columns.
COMBINERS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "sum": np.add, "avg": lambda a, b: (a + b) / 2, "max": np.maximum, "min": np.minimum, "first": lambda a, b: a + 0 * b, "last": lambda a, b: b + 0 * a,
    "product": np.multiply, "diff": lambda a, b: np.abs(b - a), "absdiff": lambda a, b: np.abs(b - a),
}


def combined(name: str, a: Block, b: Block, i: np.ndarray, j: np.ndarray, prop: tuple[str, str], by_key: bool) -> np.ndarray:
    """A property of each pair of rows; by_key: the row of the smaller key is the first one."""
    u, v = a.columns[prop[0]][i][:, None], b.columns[prop[1]][j][None, :]
    if by_key and name in ("first", "last") or by_key and prop[0] != prop[1]:
        low = a.code[i][:, None] < b.code[j][None, :]
        w, z = a.columns[prop[1]][i][:, None], b.columns[prop[0]][j][None, :]
        u, v = np.where(low, u, z), np.where(low, v, w)
    return COMBINERS[name](u, v)


class Images:
    """Smallest distances of fractional positions x to y over the 27 neighbouring images of a cell; rows of `cell` are its three vectors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cell: np.ndarray):
        self.x, self.y, self.cell = x, y, cell
        self.all = [(float(i), float(j), float(k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
        # Vectors at right angles: the nearest image is that of each of them by itself.
        gram = cell @ cell.T
        self.sides = np.sqrt(np.diag(gram)) if not (gram - np.diag(np.diag(gram))).any() else None
        if self.sides is not None:
            self.p, self.q = x, np.ascontiguousarray(y.T)
            return
        # An image and its opposite differ in the sign of one product, so that half of them are enough.
        shifts = np.array(self.all[14:]) @ cell
        centre = np.concatenate([x, y]).mean(axis=0)
        p, q = (x - centre) @ cell, (y - centre) @ cell
        self.p, self.q = p, np.ascontiguousarray(q.T)
        self.ps, self.qs = np.ascontiguousarray((2 * p @ shifts.T).T), np.ascontiguousarray((2 * q @ shifts.T).T)
        self.s2 = (shifts * shifts).sum(axis=1)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least = np.full(len(i), np.inf)
        gap = [self.y[j, c] - self.x[i, c] for c in range(3)]
        for image in self.all:
            total = np.zeros(len(i))
            for c in range(3):
                v = np.zeros(len(i))
                for r in range(3):
                    v += (gap[r] + image[r]) * self.cell[r, c]
                total += v * v
            np.minimum(least, total, out=least)
        return np.sqrt(least)

    def between(self, rows: slice, cols: slice, near: Callable[[np.ndarray], np.ndarray] | None) -> np.ndarray:
        out = np.zeros((rows.stop - rows.start, cols.stop - cols.start))
        w = np.empty_like(out)
        if self.sides is not None:
            v = np.empty_like(out)
            for c, side in enumerate(self.sides):
                np.abs(np.subtract(self.p[rows, c, None], self.q[None, c, cols], out=w), out=w)
                np.minimum(w, np.abs(np.subtract(w, 1, out=v), out=v), out=w)
                w *= side
                out += np.multiply(w, w, out=w)
            return repaired(np.sqrt(out, out=out), self, rows, cols, None, near)
        for s, p, q in zip(self.s2, self.ps, self.qs):
            np.subtract(p[rows, None], q[None, cols], out=w)
            np.abs(w, out=w)
            np.subtract(s, w, out=w)
            np.minimum(out, w, out=out)
        for c in range(3):
            np.subtract(self.p[rows, c, None], self.q[None, c, cols], out=w)
            out += np.multiply(w, w, out=w)
        np.sqrt(np.maximum(out, 0, out=out), out=out)
        return repaired(out, self, rows, cols, None, near)


def measured_images(a: Block, b: Block) -> Iterator[tuple[np.ndarray, np.ndarray, Images]]:
    """As measured(); a row's numbers are its fractional position and the nine of its structure's cell."""
    tame = lambda block: np.array([r for r, x in enumerate(block.x) if x is not None and len(x) == 12 and (np.abs(x) < 1e100).all()], int)
    i, j = tame(a), tame(b)
    if len(i) and len(j):
        yield i, j, Images(np.stack([a.x[r][:3] for r in i]), np.stack([b.x[r][:3] for r in j]), a.x[i[0]][3:].reshape(3, 3))
