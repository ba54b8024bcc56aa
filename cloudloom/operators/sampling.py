"""Deterministic and spatially stratified samples, orders and budgets."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S
from cloudloom.operators import stats
from cloudloom.operators.tables import written

#: 64-bit golden ratio.
GOLDEN = 0x9E3779B97F4A7C15
MAX_DEPTH = 21


def clamp_budget(total: int, requested: int) -> int:
    """S1."""
    return 0 if total == 0 else min(total, max(1, requested))


def clamp_budget_column(total: Column, requested: Column) -> Column:
    """S1 over rows."""
    return F.when(total == 0, 0).otherwise(F.least(total, F.greatest(F.lit(1), requested)))


def coprime_step(total: int) -> int:
    """The first odd number from (total // 2) | 1 on that shares no factor with total."""
    step = (total // 2) | 1
    while total > 1 and math.gcd(step, total) != 1:
        step += 2
    return step if total > 1 else 1


def coprime_sample(spark: SparkSession, total: int, requested: int) -> DataFrame | None:
    """point_index of the sample, made by ``spark.range``; None stands for all points."""
    k = clamp_budget(total, requested)
    if k == 0 or k >= total:
        return None
    return spark.range(k).select(F.pmod(F.lit(GOLDEN % total) + F.col("id") * coprime_step(total), F.lit(total)).alias("point_index"))


def stratified(ordered: DataFrame, n: int, k: int) -> DataFrame:
    """S3: the middle of each of k bins over n candidates numbered by ``rank``.

    A candidate computes whether it is a bin's middle; nothing is joined.
    """
    if n <= k:
        return ordered.select("point_index")
    bin_ = F.floor(((F.col("rank") + 1) * k - 1) / n)
    begin, end = F.floor(bin_ * n / k), F.floor((bin_ + 1) * n / k)
    middle = F.least(F.lit(n - 1), begin + F.floor((F.greatest(end, begin + 1) - begin) / 2))
    return ordered.where(F.col("rank") == middle).select("point_index")


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``rank``, 0 and up over the whole table, without sorting it in one task.

    Rows are range-partitioned, to as many partitions as the session shuffles to; a partition's rows are numbered from the sum of the partitions before it.  The
    numbered rows are written before they are counted: two plans of one range exchange may sample different bounds.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    parts = written(parts.withColumn("_n", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    before = counts.select("_part", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def spatial_sample(points: DataFrame, requested: int) -> DataFrame | None:
    """An octree sample: the coarsest depth with enough occupied cells, then S3 over the cells in Morton order.

    None stands for all points.  Each depth that is tried is one aggregation; flat axes count as one cell.
    """
    box = stats.bounds(points).withColumn("n", F.lit(0)).first().asDict()
    total = points.count()
    k = clamp_budget(total, requested)
    if k == 0 or k >= total:
        return None
    extent = [box[f"max_{a}"] - box[f"min_{a}"] for a in stats.AXES]
    active = [a for a, e in zip(stats.AXES, extent) if e > max(extent) * 1e-5]
    if not active:
        return coprime_sample(points.sparkSession, total, k)
    flat = {**box, **{f"max_{a}": box[f"min_{a}"] for a in stats.AXES if a not in active}}
    need = lambda ratio: math.ceil(math.log2(max(1.0, ratio ** (1 / len(active)))))
    depth = 0 if k <= 1 else min(MAX_DEPTH, need(k))
    best, best_n, best_depth = None, 0, depth
    while True:
        cells = written(stats.voxel_representatives(points, flat, depth))
        n = cells.count()
        if n > best_n:
            best, best_n, best_depth = cells, n, depth
        if best_n >= min(k, total) or depth == MAX_DEPTH:
            break
        depth = min(MAX_DEPTH, depth + min(4, max(1, need(k / best_n))))
    keyed = best.withColumn("morton", S.morton([F.col("cx"), F.col("cy"), F.col("cz")], best_depth))
    return stratified(ranked(keyed, ["morton", "point_index"]), best_n, k)


def frustum_planes(view_projection: Sequence[float]) -> list[list[float]]:
    """six unit planes (a, b, c, d), inside where ax + by + cz + d >= 0; a degenerate one is +z, 0."""
    m = np.array(view_projection, float).reshape(4, 4)
    planes = []
    for row in range(3):
        for sign in (1.0, -1.0):
            p = m[3] + sign * m[row]
            n = np.linalg.norm(p[:3])
            planes.append((p / n).tolist() if n > 1e-12 else [0.0, 0.0, 1.0, 0.0])
    return planes


def visible_cells(box: dict[str, float], grid: int, views: Sequence[Sequence[float]]) -> list[tuple[int, int, int]]:
    """cells of the grid whose box, grown by a cell on each side, is in some view's frustum."""
    lo = np.array([box[f"min_{a}"] for a in stats.AXES], float)
    size = (np.array([box[f"max_{a}"] for a in stats.AXES], float) - lo) / grid
    cells = np.stack(np.meshgrid(*[np.arange(grid)] * 3, indexing="ij"), -1).reshape(-1, 3)
    near, far = lo + (cells - 1) * size, lo + (cells + 2) * size
    seen = np.zeros(len(cells), bool)
    for view in views:
        inside = np.ones(len(cells), bool)
        for a, b, c, d in frustum_planes(view):
            p = np.where(np.array([a, b, c]) >= 0, far, near)  # the corner that lies farthest along the plane
            inside &= p @ np.array([a, b, c]) + d >= 0
        seen |= inside
    return [tuple(c) for c in cells[seen].tolist()]


def frustum_union(points: DataFrame, views: Sequence[Sequence[float]], grid: int = 32) -> tuple[DataFrame, bool]:
    """The points in cells that any view sees, and whether that is a mask.

    Nothing or everything visible is no mask: all points come back.  The cells are at most 128 ** 3 and kept as a bitmap in the plan's broadcast side.
    """
    grid = min(128, max(1, grid))
    box = stats.bounds(points).first().asDict()
    cells = visible_cells(box, grid, views)
    if not cells or len(cells) == grid**3:
        return points, False
    keys = [S.voxel(F.col(a), F.lit(float(box[f"min_{a}"])), F.lit(float(box[f"max_{a}"] - box[f"min_{a}"])), grid).alias(f"c{a}") for a in stats.AXES]
    spark = points.sparkSession
    seen = F.broadcast(spark.createDataFrame(cells, "cx long, cy long, cz long"))
    kept = points.withColumns({f"c{a}": k for a, k in zip(stats.AXES, keys)}).join(seen, ["cx", "cy", "cz"], "left_semi").drop("cx", "cy", "cz")
    return kept, True


def decimate(spark: SparkSession, n: int, k: int) -> DataFrame:
    """floor(i n / k) for each i below k."""
    return spark.range(k).select(F.floor(F.col("id") * n / k).cast("long").alias("point_index"))


def surfel_corners(indices: DataFrame) -> DataFrame:
    """6 p .. 6 p + 5 for each index p."""
    return indices.select(F.explode(F.sequence(F.col("point_index") * 6, F.col("point_index") * 6 + 5)).alias("corner"))


def lod_budget(total: int, mode: str, target: int, moving: bool) -> int:
    """Points to draw: all, or the target if level of detail is forced or the camera moves under ``auto``."""
    return min(total, target) if mode == "force" or (mode == "auto" and moving) else total


def greedy_spaced(candidates: Sequence[tuple], radius: float, k: int) -> list[tuple]:
    """Of (score, x, y, z, ...) by falling score, each that is farther than radius from those taken, k at most."""
    taken: list[tuple] = []
    for c in sorted(candidates, key=lambda c: (-c[0], *c[1:])):
        if len(taken) == k:
            break
        if all(sum((a - b) ** 2 for a, b in zip(c[1:4], t[1:4])) > radius * radius for t in taken):
            taken.append(c)
    return taken


def spaced(candidates: DataFrame, radius: float, k: int, *, block: int = 1024) -> list[tuple]:
    """S11 over a table (score, x, y, z, point_index): blocks of the best candidates until k are taken or none is left.

    What lies within the radius of a taken one is filtered out by Spark before the next block is fetched, so a block never holds more than ``block`` rows and no
    candidate is passed over.
    """
    taken: list[tuple] = []
    while len(taken) < k:
        left = candidates
        for _, x, y, z, _ in taken:
            dx, dy, dz = F.col("x") - x, F.col("y") - y, F.col("z") - z
            left = left.where(dx * dx + dy * dy + dz * dz > radius * radius)
        best = left.orderBy(F.desc("score"), "x", "y", "z", "point_index").limit(block).select("score", "x", "y", "z", "point_index").collect()
        taken += greedy_spaced([tuple(r) for r in best], radius, k - len(taken))
        if len(best) < block:
            break
    return taken


def convex_hull(vertices: Sequence[tuple[float, float]], near: float = 1e-5) -> list[tuple[float, float]]:
    """Sorted, near-duplicates dropped, then the monotone chain, counter-clockwise."""
    at: list[tuple[float, float]] = []
    for p in sorted(vertices):
        if not at or math.hypot(p[0] - at[-1][0], p[1] - at[-1][1]) > near:
            at.append(p)
    if len(at) < 3:
        return at

    def half(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(at) + half(at[::-1])


def back_to_front(splats: DataFrame, buckets: int = 2048) -> DataFrame:
    """Splats (view_depth, merged_index) numbered from the farthest bucket on, in order within a bucket.

    The numbers are ranks over the whole table, so a bucket with most of the splats is no task of its own.  Without a range of depths the order stays.
    """
    ends = splats.agg(F.min("view_depth").alias("lo"), F.max("view_depth").alias("hi"))
    both = splats.join(F.broadcast(ends))
    flat = F.col("hi") - F.col("lo") <= 1e-6
    bucket = F.when(flat, 0).otherwise(F.least(F.floor((F.col("view_depth") - F.col("lo")) / F.when(flat, 1.0).otherwise(F.col("hi") - F.col("lo")) * (buckets - 1)), F.lit(buckets - 1))).cast("int")
    keyed = both.withColumn("bucket", bucket).withColumn("_near", -F.col("bucket")).drop("lo", "hi")
    return ranked(keyed, ["_near", "merged_index"]).withColumnRenamed("rank", "draw").drop("_near")


def layer_offsets(layers: DataFrame) -> DataFrame:
    """Where each layer's rows start when the layers are laid end to end."""
    w = Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    return layers.withColumn("start", F.coalesce(F.sum("count").over(w), F.lit(0)).cast("long"))
