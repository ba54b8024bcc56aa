"""Column statistics, bounds, medians, focus points, voxel and surface aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S

AXES = ("x", "y", "z")
#: A4, A5: points that a focus point is taken from at most.
FOCUS_SAMPLE = 16_384
#: Points that are sampled at most.
SURFACE_SAMPLE, SPACING_SAMPLE = 220_000, 768


def field_stats(points: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A1: (field, min, max, count) of each field, NaN left out and -0 as 0, in one pass.

    Each field is aggregated where it is read; one row is turned into rows after that.
    """
    clean = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in fields}
    wide = points.agg(*[a for f, c in clean.items() for a in ((F.min(c) + 0.0).alias(f"{f}_0"), (F.max(c) + 0.0).alias(f"{f}_1"), F.count(c).alias(f"{f}_2"))])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_0").alias("min"), F.col(f"{f}_1").alias("max"), F.col(f"{f}_2").alias("count")) for f in fields])
    return wide.select(F.inline(rows))


def bounds(points: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """A2: least and greatest of each axis, and whether there is any point."""
    return points.agg(*[F.min(a).alias(f"min_{a}") for a in axes], *[F.max(a).alias(f"max_{a}") for a in axes], (F.count(F.lit(1)) > 0).alias("valid"))


def stride(points: DataFrame, total: int, limit: int) -> DataFrame:
    """Every ceil(total / limit)-th point; the filter is on point_index, so nothing is shuffled."""
    step = max(1, -(-total // limit))
    return points if step == 1 else points.where(F.col("point_index") % step == 0)


def upper_median(value: Column) -> Column:
    """A3 over a bounded group: the element at floor(n / 2) of the sorted values."""
    values = F.sort_array(F.collect_list(value))
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def upper_median_of(points: DataFrame, column: str, *, bins: int = 1024, few: int = 100_000) -> float | None:
    """A3 over any number of rows: narrows the range that holds the middle row by histograms until ``few`` rows are left.

    Each step is one aggregation with ``bins`` rows; no task sorts the column.
    """
    values = points.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, lo, hi = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = n // 2
    inside, left = values, n
    while left > few and hi > lo:
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))
        counts = {int(r["b"]): r for r in inside.groupBy(at.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        for b in sorted(counts):
            if rank < counts[b]["n"]:
                lo, hi, left = counts[b]["lo"], counts[b]["hi"], counts[b]["n"]
                break
            rank -= counts[b]["n"]
        inside = values.where(F.col("v").between(lo, hi))
    return lo if hi == lo else sorted(r["v"] for r in inside.collect())[rank]


def cloud_focus(points: DataFrame, total: int) -> DataFrame:
    """A4: of at most FOCUS_SAMPLE strided points, the one nearest to the upper medians of the axes; the first on ties."""
    sample = stride(points, total, FOCUS_SAMPLE).select("point_index", *AXES)
    middle = sample.agg(*[upper_median(F.col(a)).alias(f"m_{a}") for a in AXES])
    d2 = reduce(lambda a, b: a + b, [(F.col(a) - F.col(f"m_{a}")) * (F.col(a) - F.col(f"m_{a}")) for a in AXES])
    near = sample.join(F.broadcast(middle)).select(*AXES, F.struct(d2.alias("d2"), F.col("point_index")).alias("k"))
    best = near.agg(F.min(F.struct("k", *AXES)).alias("best"))
    return best.select(*[F.col(f"best.{a}").alias(a) for a in AXES])


def splat_focus(splats: DataFrame) -> DataFrame:
    """A5: the upper medians of the first FOCUS_SAMPLE splats."""
    return splats.where(F.col("point_index") < FOCUS_SAMPLE).agg(*[upper_median(F.col(a)).alias(a) for a in AXES])


def voxel_representatives(points: DataFrame, box: dict[str, float], depth: int) -> DataFrame:
    """For each occupied cell of 2 ** depth per axis, the point nearest to its centre, the smaller index on ties.

    A cell is reduced where its points are read; a row per cell and task is shuffled.
    """
    dimension = 2**depth
    keys, d2 = {}, F.lit(0.0)
    for a in AXES:
        lo, extent = F.lit(float(box[f"min_{a}"])), F.lit(float(box[f"max_{a}"] - box[f"min_{a}"]))
        size = dimension if box[f"max_{a}"] > box[f"min_{a}"] else 1
        keys[f"c{a}"] = S.voxel(F.col(a), lo, extent, size)
        off = F.col(a) - S.voxel_centre(F.col(f"c{a}"), lo, extent, size)
        d2 = d2 + off * off
    celled = points.withColumns(keys).withColumn("d2", d2)
    best = celled.groupBy(*keys).agg(F.min(F.struct("d2", "point_index")).alias("best"))
    return best.select(*keys, F.col("best.point_index").alias("point_index"), F.col("best.d2").alias("d2"))


def surface_cells(points: DataFrame, cell: float, *, total: int | None = None) -> DataFrame:
    """A row for each XY cell: mean position, least and greatest z, count, mean unit normal, confidence.

    total: if given, at most SURFACE_SAMPLE strided points are used.  Normals (nx, ny, nz) are optional.
    """
    sample = points if total is None else stride(points, total, SURFACE_SAMPLE)
    sample = sample.where(reduce(lambda a, b: a & b, [S.is_finite(F.col(a)) for a in AXES]))
    sample = sample.withColumns({"cx": S.grid_key(F.col("x"), cell), "cy": S.grid_key(F.col("y"), cell)})
    aggs = [*[F.avg(a).alias(a) for a in AXES], F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count(F.lit(1)).alias("count")]
    normals = all(c in points.columns for c in ("nx", "ny", "nz"))
    if normals:
        n = S.vec("nx", "ny", "nz")
        unit = S.normalise(n)
        aggs += [F.sum(u).alias(f"sum_{c}") for u, c in zip(unit, ("nx", "ny", "nz"))]
    cells = sample.groupBy("cx", "cy").agg(*aggs).withColumn("confidence", S.clamp(0.35 * F.sqrt(F.col("count"))))
    if normals:
        mean = S.normalise(S.vec("sum_nx", "sum_ny", "sum_nz"))
        cells = cells.withColumns(dict(zip(("nx", "ny", "nz"), mean))).drop("sum_nx", "sum_ny", "sum_nz")
    return cells


def point_spacing(points: DataFrame, total: int) -> float | None:
    """Of at most SPACING_SAMPLE strided points, the distance to the nearest other one, at the 35 % place."""
    rows = stride(points, total, SPACING_SAMPLE).where(reduce(lambda a, b: a & b, [S.is_finite(F.col(a)) for a in AXES])).select(*AXES).collect()
    import numpy as np

    at = np.array([tuple(r) for r in rows], float).reshape(-1, 3)
    if len(at) < 2:
        return None
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    d[d <= 1e-12] = np.inf
    near = np.sort(d.min(1))
    near = near[np.isfinite(near)]
    return float(near[int(0.35 * (len(near) - 1))]) if len(near) else None


def centroid(vertices: Column) -> tuple[Column, Column, Column]:
    """Mean of an array of (x, y, z)."""

    def mean(axis: str) -> Column:
        return F.aggregate(vertices, F.lit(0.0), lambda acc, v: acc + v[axis]) / F.size(vertices)

    return tuple(mean(a) for a in AXES)


def branch_diagnostics(branches: DataFrame, anchors: DataFrame) -> DataFrame:
    """Branches, mean confidence of anchors, and those of low confidence (below 0.45, or two gaps or more)."""
    low = (F.col("confidence") < 0.45) | (F.col("gaps") >= 2)
    a = anchors.agg(F.avg("confidence").alias("mean_confidence"), F.sum(low.cast("long")).alias("low_confidence"))
    return branches.agg(F.count(F.lit(1)).alias("branches")).join(F.broadcast(a))


def merge_caches(branches: DataFrame) -> DataFrame:
    """Branches of several sources (source_id, branch_id, parent_id) numbered through, parents with them.

    Numbers are running per source, offset by the branches of the sources before: only the per-source counts are summed in order.
    """
    w = Window.partitionBy("source_id").orderBy("branch_id")
    numbered = branches.withColumn("n", F.row_number().over(w) - 1)
    counts = branches.groupBy("source_id").agg(F.count(F.lit(1)).alias("k"))
    offsets = counts.select("source_id", F.coalesce(F.sum("k").over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    new = numbered.join(offsets, "source_id").withColumn("new_id", F.col("offset") + F.col("n"))
    parents = new.select("source_id", F.col("branch_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    return new.join(parents, ["source_id", "parent_id"], "left").select("source_id", "branch_id", "new_id", F.coalesce("new_parent", F.lit(-1)).cast("long").alias("new_parent"))


def unique_indices(indices: DataFrame, total: int) -> DataFrame:
    """Those in range, each once, in order."""
    return indices.where(F.col("point_index").between(0, total - 1)).select("point_index").distinct().orderBy("point_index")


def csr_ranges(members: DataFrame) -> DataFrame:
    """Where each point's run begins, and how long it is, in memberships sorted by (point, param).

    The begin is a running sum over points, taken in two levels: within ranges of point_index, and over the ranges' totals.
    """
    counts = members.groupBy("point_index").agg(F.count(F.lit(1)).alias("count"))
    ranged = counts.withColumn("slab", F.floor(F.col("point_index") / 65536))
    slabs = ranged.groupBy("slab").agg(F.sum("count").alias("n"))
    before = slabs.select("slab", F.coalesce(F.sum("n").over(Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("count").over(Window.partitionBy("slab").orderBy("point_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("own", own).join(before, "slab").select("point_index", (F.col("before") + F.col("own")).alias("start"), "count")
