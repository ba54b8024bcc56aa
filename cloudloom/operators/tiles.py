"""Neighbours within a radius, tile by tile: what becomes of a row's neighbours is worked out beside them, so pairs are never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.functions import scalar as S

#: Edge of a tile in radii; a right row is copied to the tiles within the radius, to 4.6 in space.
TILE = 3.0
#: Distances worked out at once, and pairs from which a kernel is called.
CHUNK, PAIRS = 1 << 20, 1 << 19

Columns = dict[str, np.ndarray]
Kernel = Callable[[Columns, Columns, np.ndarray, np.ndarray, np.ndarray], Columns]


def squared(radius: float) -> float:
    """The double next to the square of the radius as it is written: 0.0025 for 0.05, where 0.05 * 0.05 is above."""
    return float(Decimal(repr(float(radius))) ** 2)


class _Cells:
    """Right rows of a tile by cells a little wider than the radius."""

    def __init__(self, rows: Columns, axes: Sequence[str], radius: float, strict: bool):
        self.edge, self.axes, self.limit, self.strict = max(radius, 1e-4) * 1.001, axes, squared(radius), strict
        cells = [np.floor(rows[a] / self.edge).astype(np.int64) for a in axes]
        self.low = [int(c.min()) - 1 for c in cells]
        self.span = [int(c.max()) - low + 2 for c, low in zip(cells, self.low)]
        key = self._key([c - low for c, low in zip(cells, self.low)])
        order = np.argsort(key, kind="stable")
        self.key, self.rows = key[order], {k: v[order] for k, v in rows.items()}

    def _key(self, cells: Sequence[np.ndarray]) -> np.ndarray:
        key = cells[0]
        for c, n in zip(cells[1:], self.span[1:]):
            key = key * n + c
        return key

    def pairs(self, left: Columns) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of left, i, j, d2): all pairs of some left rows, i into those rows and sorted, j into ``self.rows``."""
        cells = [np.floor(left[a] / self.edge).astype(np.int64) - low for a, low in zip(self.axes, self.low)]
        inside = np.flatnonzero(np.logical_and.reduce([(c >= 0) & (c < n) for c, n in zip(cells, self.span)]))
        if not len(inside):
            return
        key = self._key([c[inside] for c in cells])
        order = np.argsort(key, kind="stable")
        inside, key = inside[order], key[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends, firsts = np.concatenate((begins[1:], [len(key)])), key[begins]
        # Along the last axis the three cells of a row of cells are neighbours in the order.
        shifts = np.zeros(1, np.int64)
        for axis in range(len(self.axes) - 1):
            step = int(np.prod(self.span[axis + 1 :]))
            shifts = (shifts[:, None] + step * np.arange(-1, 2)).ravel()
        starts = np.searchsorted(self.key, firsts[:, None] + shifts - 1)
        stops = np.searchsorted(self.key, firsts[:, None] + shifts + 1, "right")
        at = [self.rows[a] for a in self.axes]
        who, ii, jj, dd, n, m = [], [], [], [], 0, 0
        for g in np.flatnonzero((stops > starts).any(axis=1)).tolist():
            near = np.concatenate([np.arange(a, b) for a, b in zip(starts[g].tolist(), stops[g].tolist()) if b > a])
            there = [x[near] for x in at]
            step = max(1, CHUNK // len(near))
            for a in range(begins[g], ends[g], step):
                rows = inside[a : min(a + step, ends[g])]
                d2 = None
                for axis, x in zip(self.axes, there):
                    d = left[axis][rows][:, None] - x
                    d *= d
                    d2 = d if d2 is None else np.add(d2, d, out=d2)
                i, j = np.nonzero(d2 < self.limit if self.strict else d2 <= self.limit)
                who.append(rows)
                ii.append(i + n)
                jj.append(near[j])
                dd.append(d2[i, j])
                n, m = n + len(rows), m + len(i)
                if m >= PAIRS:
                    yield np.concatenate(who), np.concatenate(ii), np.concatenate(jj), np.concatenate(dd)
                    who, ii, jj, dd, n, m = [], [], [], [], 0, 0
        if m:
            yield np.concatenate(who), np.concatenate(ii), np.concatenate(jj), np.concatenate(dd)


def gathered(left: DataFrame, right: DataFrame, radius: float, kernel: Kernel, schema: str, *, axes: Sequence[str] = ("x", "y", "z"), strict: bool = False, few: bool = False) -> DataFrame:
    """What ``kernel`` makes of the pairs of left and right rows within the radius: a table of ``schema``.

    kernel(l, r, i, j, d2) gets columns of left and right rows as arrays, and all pairs of these left rows: l's i-th and r's j-th, i sorted.  Columns are whole numbers or doubles,
    without nulls.  Left rows are shuffled once and come in batches; the right rows of a tile and of the radius around it are held by the task.  Rows without a place meet nothing.
    few: left rows are so few that their tiles are sent to the right ones, of which only those are shuffled.
    """
    spark = left.sparkSession
    kinds = {f.name: "long" if isinstance(f.dataType, T.IntegralType) else "double" for df in (right, left) for f in df.schema.fields}
    edge, halo = max(radius, 1e-4) * TILE, max(radius, 1e-4) * 1.001
    tiles = [f"_t{a}" for a in axes]

    def placed(df: DataFrame, side: int) -> DataFrame:
        finite = df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns]).where(reduce(lambda a, b: a & b, [S.is_finite(F.col(a)) for a in axes]))
        for a, t in zip(axes, tiles):
            lo, hi = (F.floor((F.col(a) + d) / edge).cast("long") for d in ((0.0, 0.0) if side else (-halo, halo)))
            finite = finite.withColumn(t, lo if side else F.explode(F.sequence(lo, hi)))
        return finite.select(*tiles, F.lit(side).alias("_side"), *[F.col(c) if c in df.columns else F.lit(0).cast(k).alias(c) for c, k in kinds.items()])

    lefts, rights = placed(left, 1), placed(right, 0)
    if few:
        rights = rights.join(F.broadcast(lefts.select(*tiles).distinct()), tiles, "left_semi")
    both = rights.unionByName(lefts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, out = list(kinds), T._parse_datatype_string(schema)
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}
    types = pa.schema([(f.name, arrow[f.dataType.simpleString()]) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, cells = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.stack([batch.column(k).to_numpy() for k in range(len(tiles) + 1)])
            rows = {c: batch.column(len(tiles) + 1 + k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
            cuts = np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if tile != (now := tuple(head[:-1, a].tolist())):
                    tile, held, cells = now, [], None
                part = {c: v[a:b] for c, v in rows.items()}
                if head[-1, a] == 0:
                    held.append(part)
                elif held:
                    cells = cells or _Cells({c: np.concatenate([h[c] for h in held]) for c in names}, axes, radius, strict)
                    for who, i, j, d2 in cells.pairs(part):
                        made = kernel({c: v[who] for c, v in part.items()}, cells.rows, i, j, d2)
                        n = len(made[types.names[0]])
                        for at in range(0, n, 65536):
                            yield pa.RecordBatch.from_arrays([pa.array(made[f.name][at : at + 65536], f.type) for f in types], schema=types)

    return both.repartition(parts, *tiles).sortWithinPartitions(*tiles, "_side").mapInArrow(run, out)


def starts(i: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)


def best(i: np.ndarray, worth: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, worth, name) of the greatest worth in each run of i, the smaller name on ties."""
    begin = starts(i)
    if not len(begin):
        return i, worth, name
    top = np.maximum.reduceat(worth, begin)
    tied = np.where(worth == np.repeat(top, np.diff(np.append(begin, len(i)))), name, np.iinfo(np.int64).max)
    return i[begin], top, np.minimum.reduceat(tied, begin)
