"""Polygon regions: boundaries, containment, edge weights, selections."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S
from cloudloom.operators import sampling, stats

Vertex = tuple[float, float, float]
#: F2: slack of the bounds.
SLACK = 1e-5
#: Regions that are sent to every task.
MOST_SENT = 10_000


def clean_boundary(vertices: Sequence[Vertex], near: float = 1e-5) -> list[Vertex]:
    """finite vertices without consecutive near-duplicates, the closing one included."""
    out: list[Vertex] = []
    for v in vertices:
        if all(map(math.isfinite, v)) and (not out or math.dist(v, out[-1]) > near):
            out.append(tuple(map(float, v)))
    if len(out) > 1 and math.dist(out[0], out[-1]) <= near:
        out.pop()
    return out


def boundary_column(vertices: Column) -> Column:
    """F12 over an array column of (x, y, z)."""

    def far(a: Column, b: Column) -> Column:
        return reduce(lambda p, q: p + q, [(a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"]) > 1e-10

    finite = F.filter(vertices, lambda v: S.is_finite(v["x"]) & S.is_finite(v["y"]) & S.is_finite(v["z"]))
    kept = F.aggregate(finite, F.slice(finite, 1, 0), lambda acc, v: F.when((F.size(acc) == 0) | far(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), v), F.concat(acc, F.array(v))).otherwise(acc))
    closing = (F.size(kept) > 1) & ~far(F.element_at(kept, 1), F.element_at(kept, F.greatest(F.size(kept), F.lit(1))))
    return F.when(closing, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)


def _edges(boundary: Sequence[Vertex]) -> list[tuple[Vertex, Vertex]]:
    return [(boundary[i], boundary[i - 1]) for i in range(len(boundary))]


def inside(x: Column, y: Column, boundary: Sequence[Vertex]) -> Column:
    """even-odd in XY; edges that are level within 1e-8 never cross.  One term for each edge, all in generated code."""
    if len(boundary) < 3:
        return F.lit(False)
    crossings = []
    for (ax, ay, _), (bx, by, _) in _edges(boundary):
        if abs(by - ay) > 1e-8:
            crossings.append((((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int"))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1 if crossings else F.lit(False)


def inside_column(x: Column, y: Column, boundary: Column) -> Column:
    """F1 against an array column, for regions that are rows."""
    n = F.size(boundary)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(boundary, i).alias("a"), F.element_at(boundary, F.when(i > 1, i - 1).otherwise(n)).alias("b")))

    def crosses(e: Column) -> Column:
        rise = e["b"]["y"] - e["a"]["y"]
        level = F.abs(rise) <= 1e-8
        at = (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(level, 1.0).otherwise(rise) + e["a"]["x"]
        return ~level & ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < at)

    return F.when(n < 3, F.lit(False)).otherwise(F.size(F.filter(edges, crosses)) % 2 == 1)


def in_bounds(x: Column, y: Column, boundary: Sequence[Vertex]) -> Column:
    """the boundary's rectangle, as plain comparisons that reach the Parquet scan."""
    if not boundary:
        return F.lit(True)
    xs, ys = [v[0] for v in boundary], [v[1] for v in boundary]
    return (x >= min(xs) - SLACK) & (x <= max(xs) + SLACK) & (y >= min(ys) - SLACK) & (y <= max(ys) + SLACK)


def _segment_distance(p: Sequence[Column], a: Sequence[float], b: Sequence[float]) -> Column:
    ab = [q - r for q, r in zip(b, a)]
    n2 = sum(c * c for c in ab)
    if n2 <= 1e-8:
        return S.length([x - c for x, c in zip(p, a)])
    t = S.clamp(S.dot([x - c for x, c in zip(p, a)], ab) / n2)
    return S.length([x - (c + d * t) for x, c, d in zip(p, a, ab)])


def edge_distance(p: S.Vec, boundary: Sequence[Vertex]) -> Column:
    """To the nearest edge in 3-D, or in XY where that is 0."""
    if len(boundary) < 2:
        return F.lit(0.0)
    least = lambda n: F.least(*[_segment_distance(p[:n], a[:n], b[:n]) for a, b in _edges(boundary)])
    d3 = least(3)
    return F.when(d3 > 0, d3).otherwise(least(2))


def select_region(points: DataFrame, vertices: Sequence[Vertex], *, layer_id: int = 0, blend: float = 0.05, direction: Sequence[float] = (1.0, 0.0, 0.0), strength: float = 1.0, feature: str = "ripple", view_projection: Sequence[float] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """the points in a region, with edge_distance, edge_weight, field vector (fx, fy, fz), wetness, confidence and flags.

    Cheap tests first: the rectangle (at the scan), the clip test, the polygon.  candidates: if given, only those point_index.
    There is no cap on the points (S12 caps field surfaces only).
    """
    boundary = clean_boundary(vertices)
    x, y, z = S.vec("x", "y", "z")
    kept = points if candidates is None else points.join(candidates.select("point_index"), "point_index", "left_semi")
    if len(boundary) < 3:
        kept = kept.limit(0)
    kept = kept.where(in_bounds(F.col("x"), F.col("y"), boundary))
    if view_projection is not None:
        kept = kept.where(S.in_clip(S.clip((x, y, z), view_projection)))
    kept = kept.where(inside(x, y, boundary)).withColumn("edge_distance", edge_distance((x, y, z), boundary))
    up = (0.0, 0.0, 1.0)
    kept = S.staged(kept, _n=S.normalise(S.vec("nx", "ny", "nz"), fallback=up) if "nx" in points.columns else tuple(F.lit(c) for c in up))
    n = math.sqrt(sum(d * d for d in direction))
    d = [c / n for c in direction] if n * n > 1e-12 else [1.0, 0.0, 0.0]
    kept = kept.withColumn("_along", S.dot(S.at("_n"), d))
    kept = S.staged(kept, _f=tuple(F.lit(c) - m * F.col("_along") for c, m in zip(d, S.at("_n"))))
    flat = S.at("_f")
    kept = S.staged(kept, _u=S.normalise(flat), _s=S.lateral(S.at("_n"), tuple(F.lit(c) for c in up)))
    field = [F.when(S.dot(flat, flat) <= 1e-12, s).otherwise(u) for s, u in zip(S.at("_s"), S.at("_u"))]
    weight = S.smoothstep(0.0, max(1e-5, blend), F.col("edge_distance"))
    kept = kept.withColumns({"layer_id": F.lit(layer_id), "edge_weight": weight, **dict(zip(("fx", "fy", "fz"), field))})
    return S.unstaged(kept, "_n", "_f", "_u", "_s").drop("_along").withColumns(
        {
            "wetness": S.clamp(strength * F.col("edge_weight")),
            "field_confidence": S.clamp(0.35 + 0.65 * F.col("edge_weight")),
            "flow_blocked": F.lit(feature == "no_flow"),
            "bridge_allowed": F.lit(feature == "bridge_allowed"),
            "bridge_blocked": F.lit(feature == "bridge_blocked"),
        }
    )


def select_regions(points: DataFrame, layers: DataFrame, feature: str) -> DataFrame:
    """(layer_id, point_index) of all layers of a type that are on for view or export and have three vertices.

    layers: layer_id, feature, viewport, export, vertices; an authored table, a row for each region.
    """
    wanted = layers.where((F.col("feature") == feature) & (F.col("viewport") | F.col("export"))).withColumn("boundary", boundary_column(F.col("vertices"))).where(F.size("boundary") >= 3)
    ends = lambda f, c: f(F.transform("boundary", lambda v: v[c]))
    slim = wanted.select("layer_id", "boundary", *[ends(f, c).alias(f"{n}_{c}") for n, f in (("lo", F.array_min), ("hi", F.array_max)) for c in "xy"])
    near = (F.col("x") >= F.col("lo_x") - SLACK) & (F.col("x") <= F.col("hi_x") + SLACK) & (F.col("y") >= F.col("lo_y") - SLACK) & (F.col("y") <= F.col("hi_y") + SLACK)
    few = slim.limit(MOST_SENT + 1).count() <= MOST_SENT  # beyond, Spark chooses
    both = points.select("point_index", "x", "y").join(F.broadcast(slim) if few else slim, near)
    return both.where(inside_column(F.col("x"), F.col("y"), F.col("boundary"))).select("layer_id", "point_index")


def clip_stream(samples: DataFrame, boundary: Sequence[Vertex]) -> DataFrame:
    """visible samples (role 1) outside the polygon go; route rows (role 0) stay."""
    return samples.where((F.col("stream_role") < 0.5) | inside(F.col("x"), F.col("y"), clean_boundary(boundary)))


def control_flags(nodes: DataFrame, selections: DataFrame) -> DataFrame:
    """Which controls a node's point is in: selections (point_index, flow_blocked, bridge_allowed, bridge_blocked)."""
    names = ("flow_blocked", "bridge_allowed", "bridge_blocked")
    flags = selections.groupBy("point_index").agg(*[F.max(n).alias(n) for n in names])
    return nodes.join(flags, "point_index", "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})


def cap_points(selected: DataFrame, n: int, most: int) -> DataFrame:
    """Every k-th point so that ``most`` are left about."""
    return stats.stride(selected, n, most)


def hull(vertices: Sequence[Vertex]) -> list[tuple[float, float]]:
    """D9j, S6."""
    return sampling.convex_hull([v[:2] for v in vertices])
