"""Pairs of near vectors, exactly, through cells around pivots and blocks of cells (survey J10).

Directions x/|x| of a pair above the threshold t are at most r = sqrt(2 - 2 t / m^2) apart, m being the greatest length.
Every vector has its home in the cell of its nearest pivot; cells that are close are put together into blocks of bounded
size, and a cell larger than that is cut into several. A block is stored once, as one row, and read by the tasks that
compare it with itself and with each other block. They leave out vectors and small tiles for which the triangle inequality
rules out the other side's cells (by the distance to the cell's border, and to its pivot against the cell's radius), and
compare the rest by matrix products; only pairs that qualify leave them. Where no triangle rules anything out, the work is
that of a blocked matrix product; what is stored and sent to tasks does not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

#: Rows of a tile; a block has one to 32 tiles.
CHUNK = 2048
#: Most pivots: the table of pivots and cells is sent to all executors.
MOST_PIVOTS = 4096
#: Bytes of a block's vectors, at most.
BLOCK_BYTES = 16 << 20
_SLACK = 1e-6  # on distances between directions, which are computed from 64-bit floats
_ENTRIES = 1 << 20  # of a matrix that is made at once


def _rows(column) -> np.ndarray:
    """Arrow lists of numbers as the rows of a matrix; what is not a 32-bit float becomes a 64-bit one."""
    flat = column.flatten()
    if not pa.types.is_float32(flat.type):
        flat = flat.cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x/|x|, |x|); zero where there is no direction."""
    x = x.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    some = (length > 0) & np.isfinite(length)
    return np.where(some[:, None], x, 0.0) / np.where(some, length, 1.0)[:, None], length


def _apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


class Cells:
    """Pivots (unit vectors), and the number of vectors and the radius of each one's cell."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.count = np.zeros(len(pivots), np.int64)
        self.radius = np.zeros(len(pivots))

    @cached_property
    def between(self) -> np.ndarray:
        """Distances of the pivots; made where they are used, as they are many more than the pivots."""
        return np.concatenate([_apart(self.pivots[i : i + 256] @ self.pivots.T).astype(np.float32) for i in range(0, len(self.pivots), 256)])

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, distances to all pivots)."""
        d = _apart(x @ self.pivots.T)
        return d.argmin(1), d

    def parts(self, n: int) -> Iterator[slice]:
        """Slices of n rows for which ``near`` stays small."""
        step = max(64, _ENTRIES // len(self.pivots))
        return (slice(at, at + step) for at in range(0, n, step))

    def can_hold(self, home: np.ndarray, own: np.ndarray, d: np.ndarray, cells: slice, r: float) -> np.ndarray:
        """[vector, cell]: whether the cell can hold a vector within r. own, d: distances to the home's pivot and the cells'."""
        if r >= 2:
            return np.ones(d.shape, bool)
        between = self.between[home, cells]
        # near or equal pivots have a border that rounding could move
        border = (d**2 - own[:, None] ** 2) / np.where(between > 1e-3, 2 * between, np.inf)
        return (border <= r + _SLACK) & (d <= r + self.radius[cells] + _SLACK)

    def visited(self, home: np.ndarray, d: np.ndarray, r: float) -> np.ndarray:
        """[vector, cell]: the cells besides its own that can hold a vector within r."""
        out = self.can_hold(home, np.take_along_axis(d, home[:, None], 1)[:, 0], d, slice(None), r)
        out[np.arange(len(home)), home] = False
        return out

    def possible(self, x: np.ndarray, home: np.ndarray, low: int, high: int, r: float) -> np.ndarray:
        """[direction, cell]: whether the cells from low to before high can hold a vector within r."""
        own = _apart(np.einsum("ij,ij->i", x, self.pivots[home]))
        return self.can_hold(home, own, _apart(x @ self.pivots[low:high].T), slice(low, high), r)


class Blocks:
    """Cells in a new order, in which those of a block follow each other.

    ``group``: of each cell, ``chunks``: the blocks that a group is cut into (one cell, if more than one block), ``block``:
    the first of them.
    """

    def __init__(self, cells: Cells, most: int):
        groups, todo = [], [np.arange(len(cells.pivots))]
        while todo:
            of = todo.pop()
            n = int(cells.count[of].sum())
            if len(of) == 1 or n <= most * 1.25:
                groups.append(of)
                continue
            p = cells.pivots[of]
            a = p[((p - p.mean(0)) ** 2).sum(1).argmax()]
            b = p[((p - a) ** 2).sum(1).argmax()]
            of = of[np.argsort(p @ (a - b), kind="stable")]
            m = -(-n // most)
            at = int(np.searchsorted(np.cumsum(cells.count[of]), n * (m // 2) / m)) + 1
            at = min(max(1, at), len(of) - 1)
            todo += [of[at:], of[:at]]
        order = np.concatenate(groups)
        self.cells = Cells(cells.pivots[order])
        self.cells.count, self.cells.radius = cells.count[order], cells.radius[order]
        sizes = np.array([len(g) for g in groups])
        self.group = np.repeat(np.arange(len(groups)), sizes)
        self.chunks = np.array([-(-int(cells.count[g].sum()) // most) if len(g) == 1 else 1 for g in groups]).clip(1)
        self.block = np.cumsum(self.chunks) - self.chunks

    def __len__(self) -> int:
        return int(self.chunks.sum())

    def of(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, home) of directions."""
        home = self.cells.near(x)[0]
        g = self.group[home]
        return self.block[g] + (pd.util.hash_array(ids.astype(np.int64)).astype(np.uint64) % self.chunks[g].astype(np.uint64)).astype(np.int64), home


def _homes(cells) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cells.value
        count, radius, longest = np.zeros(len(c.pivots), np.int64), np.zeros(len(c.pivots)), np.zeros(len(c.pivots))
        for batch in batches:
            x = _rows(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
            for part in c.parts(len(x)):
                u, length = _directions(x[part])
                home, d = c.near(u)
                np.add.at(count, home, 1)
                np.maximum.at(radius, home, d.min(1))
                np.fmax.at(longest, home, length)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": count[at], "radius": radius[at], "longest": longest[at]})

    return run


def _dealt(blocks) -> Callable:
    """Each vector once: (block, home, id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = blocks.value
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column("id").to_numpy(), _rows(batch.column("v"))
                at = [np.concatenate(f).astype(np.int32) for f in zip(*(b.of(ids[part], _directions(x[part])[0]) for part in b.cells.parts(len(x))))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, at), batch.column("id"), batch.column("v")], names=["block", "home", "id", "v"])

    return run


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: numbers, homes in ascending order, ids and vectors as bytes."""
    parts: dict[int, list] = {}
    for batch in batches:
        block, home, ids = (batch.column(f).to_numpy() for f in ("block", "home", "id"))
        v = _rows(batch.column("v")) if len(block) else None
        for b in np.unique(block):
            mine = block == b
            parts.setdefault(int(b), []).append((home[mine], ids[mine], v[mine]))
    for b in list(parts):
        home, ids, v = map(np.concatenate, zip(*parts.pop(b)))
        order = np.argsort(home, kind="stable")
        yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32())} | {f: pa.array([x[order].tobytes()], pa.binary()) for f, x in (("homes", home), ("ids", ids), ("vectors", v))})


class _Side:
    """A stored block."""

    def __init__(self, homes, ids, vectors, kind: str):
        self.home, self.ids = np.frombuffer(homes, np.int32), np.frombuffer(ids, np.int64)
        self._set(np.frombuffer(vectors, kind).reshape(len(self.ids), -1))

    def _set(self, v: np.ndarray) -> None:
        self.v = v
        self.short = v.astype(np.float32, copy=False)
        self.longest = float(np.sqrt(np.fmax.reduce(np.einsum("ij,ij->i", v, v, dtype=np.float64), initial=0.0)))

    def keep(self, c: Cells, other: _Side, r: float, step: int) -> None:
        """Only the vectors that the other side's cells can hold a vector within r of."""
        low, high = int(other.home[0]), int(other.home[-1]) + 1
        parts = (slice(at, at + step) for at in range(0, len(self.ids), step))
        mine = np.concatenate([c.possible(_directions(self.v[p])[0], self.home[p], low, high, r).any(1) for p in parts])
        if not mine.all():
            self.home, self.ids = self.home[mine], self.ids[mine]
            self._set(self.v[mine])


def _compared(blocks, r: float, chunk: int, threshold: float, strict: bool, kind: str) -> Callable:
    above = np.greater if strict else np.greater_equal

    def tile(x: _Side, xs: np.ndarray, y: _Side, ys: slice, same: bool) -> Iterator[pa.RecordBatch]:
        """32-bit products leave out what cannot qualify; 64-bit ones decide."""
        # a product of n terms and its rounded factors are off by less than (n + 2) 2^-23 |x| |y|
        low = threshold - (x.v.shape[1] + 4) * 2.0**-23 * x.longest * y.longest
        hit = x.short[xs] @ y.short[ys].T >= np.float32(low)
        n = np.count_nonzero(hit)
        if not n:
            return
        if n > hit.size // 16:
            s = x.v[xs].astype(np.float64) @ y.v[ys].astype(np.float64).T
            a, b = np.nonzero(above(s, threshold))
            s = s[a, b]
        else:
            a, b = np.nonzero(hit)
            s = np.concatenate([np.einsum("ij,ij->i", x.v[xs[a[k : k + chunk]]].astype(np.float64), y.v[ys][b[k : k + chunk]].astype(np.float64)) for k in range(0, n, chunk)])
        u, w = x.ids[xs[a]], y.ids[ys][b]
        keep = above(s, threshold) & (u != w)
        if same:
            keep &= b + ys.start < xs[a]
        if keep.any():
            u, w = u[keep], w[keep]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(u, w), "b": np.maximum(u, w), "sim": s[keep]})

    def meet(c: Cells, x: _Side, y: _Side, same: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, chunk // 4)
        if r < 2 and not same:
            y.keep(c, x, r, step)
        if not len(y.ids):
            return
        low, high = int(y.home[0]), int(y.home[-1]) + 1
        for at in range(0, len(x.ids), step):
            xs = np.arange(at, min(len(x.ids), at + step))
            end, cells = xs[-1] + 1 if same else len(y.ids), None
            if r < 2:
                can = c.possible(_directions(x.v[xs])[0], x.home[xs], low, high, r)
                xs, cells = xs[can.any(1)], can.any(0)
            for to in range(0, end if len(xs) else 0, chunk):
                ys = slice(to, min(len(y.ids), to + chunk))
                if cells is None or cells[y.home[to] - low : y.home[ys.stop - 1] - low + 1].any():
                    yield from tile(x, xs, y, ys, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, *one = (batch.column(f)[k] for f in ("i", "homes_i", "ids_i", "vectors_i"))
                j, *other = (batch.column(f)[k] for f in ("j", "homes_j", "ids_j", "vectors_j"))
                x, y = (_Side(*(f.as_buffer() for f in side), kind) for side in (one, other))
                yield from meet(blocks.value.cells, x, y, i.as_py() == j.as_py())

    return run


def vector_pairs(items: DataFrame, threshold: float, strict: bool = True, id_col: str = "id", vec_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(a, b, sim), a < b, with an inner product above ``threshold`` (or equal, unless ``strict``): the cosine of unit vectors.

    ``items``: ids and vectors of one dimension; the more even their lengths, the more is ruled out. ``pivots``: by default
    four times the square root of the number of items, ``MOST_PIVOTS`` at most, or one where all items are two chunks or
    less; they are items (those with the smallest hashes of their ids), so they follow the data's density. Rows without an
    id or a vector have no pair; fewer than two items give none. Many equal vectors are a long list of pairs, made by many
    tasks.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long, sim double")
    k = max(1, min(MOST_PIVOTS, n, pivots or (int(4 * n**0.5) if n > 2 * CHUNK else 1)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(k).select("v").toArrow()
    chosen = _directions(_rows(chosen.column("v").combine_chunks()))[0]
    made = Cells(np.unique(chosen, axis=0))
    stats = rows.mapInArrow(_homes(spark.sparkContext.broadcast(made)), "cell long, n long, radius double, longest double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("longest").alias("longest")).toPandas()
    made.count[stats["cell"]], made.radius[stats["cell"]] = stats["n"], stats["radius"]
    length = float(stats["longest"].max())
    r = max(0.0, 2 - 2 * threshold / length**2) ** 0.5 if threshold > 0 and length > 0 else 2.0
    kind = "f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "f8"
    # enough blocks for all cores to have some of their pairs
    wanted = -(-n // int(np.ceil((8 * spark.sparkContext.defaultParallelism) ** 0.5)))
    blocks = Blocks(made, max(1, min(max(wanted, CHUNK), 32 * CHUNK, BLOCK_BYTES // (int(kind[1]) * max(1, chosen.shape[1])))))
    sent = spark.sparkContext.broadcast(blocks)
    dealt = rows.mapInArrow(_dealt(sent), f"block int, home int, id long, v {rows.schema['v'].dataType.simpleString()}")
    stored = checkpointed(dealt.repartitionById(len(blocks), "block").mapInArrow(_stored, "block int, homes binary, ids binary, vectors binary"))
    one, other = (stored.select(F.col("block").alias(b), *(F.col(f).alias(f"{f}_{b}") for f in ("homes", "ids", "vectors"))) for b in "ij")
    tasks = one.hint("shuffle_replicate_nl").join(other, F.col("i") <= F.col("j"))
    return tasks.mapInArrow(_compared(sent, r, CHUNK, threshold, strict, kind), "a long, b long, sim double")
