"""Ordered rows: path windows, islands, apportionment, frames, splines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S
from cloudloom.operators import sampling

AXES = ("x", "y", "z")


def _path(key: Sequence[str] = ("path_id",), order: Sequence[str] = ("seq",)):
    return Window.partitionBy(*key).orderBy(*order)


def step_length(w, axes: Sequence[str] = AXES) -> Column:
    """Distance from the row before; 0 for a path's first."""
    d = [F.col(a) - F.lag(a).over(w) for a in axes]
    return F.coalesce(F.sqrt(reduce(lambda p, q: p + q, [x * x for x in d])), F.lit(0.0))


def path_distances(anchors: DataFrame, normal_length: float = 1.0) -> DataFrame:
    """Running distance; accumulation, its share of ``normal_length``; phase, from distance and emitter."""
    w = _path()
    out = anchors.withColumn("step", step_length(w)).withColumn("path_distance", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")
    emitter = F.col("emitter_id") if "emitter_id" in anchors.columns else F.lit(0.0)
    phase = F.when(F.col("path_distance") > 0, (F.col("path_distance") * 0.37 + emitter * 0.173) % 1.0).otherwise(0.0)
    return out.withColumns({"accumulation": S.clamp(F.col("path_distance") / max(0.001, normal_length)), "phase": phase})


def path_lengths(anchors: DataFrame) -> DataFrame:
    """A10: (path_id, length)."""
    return anchors.withColumn("step", step_length(_path())).groupBy("path_id").agg(F.sum("step").alias("length"))


def smooth_paths(anchors: DataFrame, smoothing: float) -> DataFrame:
    """1 + round(5 s) steps, each mixing 0.12 + 0.48 s of the neighbours' mean into every inner anchor.

    All steps use one window over the paths, so the data is shuffled once.
    """
    s = min(1.0, max(0.0, smoothing))
    if s <= 1e-4:
        return anchors
    w, amount = _path(), 0.12 + 0.48 * s
    for _ in range(1 + int(5 * s + 0.5)):
        new = {}
        for a in AXES:
            mean = (F.lag(a).over(w) + F.lead(a).over(w)) * 0.5
            new[a] = F.coalesce(S.lerp(F.col(a), mean, amount), F.col(a))
        anchors = anchors.withColumns(new)
    return anchors


def tangents(anchors: DataFrame) -> DataFrame:
    """Unit vector from the row before to the row after, those clamped at the ends."""
    w = _path()
    d = tuple(F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a)) for a in AXES)
    return anchors.withColumns(dict(zip(("dx", "dy", "dz"), d))).withColumns(dict(zip(("tx", "ty", "tz"), S.normalise(S.vec("dx", "dy", "dz"))))).drop("dx", "dy", "dz")


def turbulence(anchors: DataFrame) -> DataFrame:
    """The greater of the slope and 1.4 times the curvature (1 - cosine of the turn) at each anchor."""
    w = _path()
    a = tuple(F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in AXES)
    b = tuple(F.coalesce(F.lead(c).over(w), F.col(c)) - F.col(c) for c in AXES)
    out = anchors.withColumns({f"a{c}": v for c, v in zip(AXES, a)} | {f"b{c}": v for c, v in zip(AXES, b)})
    ua, ub = S.normalise(S.vec("ax", "ay", "az")), S.normalise(S.vec("bx", "by", "bz"))
    both = (S.dot(ua, ua) > 0) & (S.dot(ub, ub) > 0)
    curve = F.when(both, S.clamp((1.0 - S.dot(ua, ub)) * 0.5)).otherwise(0.0)
    slope = F.abs(F.when(S.dot(ub, ub) > 0, ub[2]).otherwise(ua[2]))
    return out.withColumn("turbulence", F.greatest(S.clamp(slope), 1.4 * curve)).drop(*[f"{p}{c}" for p in "ab" for c in AXES])


def flow_paths(rows: DataFrame, anchor_role: int = 0) -> DataFrame:
    """Anchors grouped where flow_id changes along ``seq`` within a layer; paths of one anchor go."""
    w = _path(("layer",), ("seq",))
    anchors = rows.where(F.col("particle_role") == anchor_role)
    changed = F.coalesce((F.col("flow_id") != F.lag("flow_id").over(w)).cast("int"), F.lit(0))
    numbered = anchors.withColumn("changed", changed).withColumn("path_no", F.sum("changed").over(w)).drop("changed")
    n = F.count(F.lit(1)).over(Window.partitionBy("layer", "path_no"))
    return numbered.withColumn("n", n).where(F.col("n") >= 2).drop("n")


def gap_islands(nodes: DataFrame, *, resolution: float, max_bridge: float, aggression: float = 0.0, threshold: float = 0.5, fade: bool = True) -> DataFrame:
    """Nodes (path_id, seq, x, y, z, confidence, flow_blocked, bridge_allowed, bridge_blocked) cut into sessions.

    A session ends at a blocked or too uncertain node, which goes; before a blocked bridge; before a gap above the limit, four times that where a bridge
    is allowed.  Added: island, gap, fade; islands of one node go.
    """
    limit = max(max_bridge, resolution * (1.25 + aggression * 4.0))
    uncertain = F.col("confidence") < threshold * 0.35 if fade else F.lit(False)
    w = _path()
    marked = nodes.withColumn("gone", F.col("flow_blocked") | uncertain)
    prev = {c: F.lag(c).over(w) for c in ("gone", "bridge_allowed", "bridge_blocked")}
    gap = step_length(w)
    allowed = prev["bridge_allowed"] | F.col("bridge_allowed")
    cut = prev["gone"] | prev["bridge_blocked"] | F.col("bridge_blocked") | ((gap > limit) & (~allowed | (gap > limit * 4.0)))
    numbered = marked.withColumns({"gap": gap, "cut": F.coalesce(cut, F.lit(True)).cast("int")}).withColumn("island", F.sum("cut").over(w))
    kept = numbered.where(~F.col("gone"))
    n = F.count(F.lit(1)).over(Window.partitionBy("path_id", "island"))
    soft = S.smoothstep(threshold * 0.35, max(threshold, threshold * 0.35 + 1e-4), F.col("confidence")) if fade else F.lit(1.0)
    return kept.withColumn("n", n).where(F.col("n") >= 2).withColumn("fade", soft).drop("n", "gone", "cut")


def gap_diagnostics(nodes: DataFrame, *, resolution: float, max_bridge: float, aggression: float = 0.0, threshold: float = 0.5) -> DataFrame:
    """Counts of blocks, low confidence, accepted and rejected gaps, and the extremes of those gaps."""
    limit, start = max(max_bridge, resolution * (1.25 + aggression * 4.0)), resolution * 1.25
    w = _path()
    low = F.col("confidence") < threshold * 0.35
    marked = nodes.withColumns({"gap": step_length(w), "gone": F.col("flow_blocked") | low})
    joined = F.coalesce(~F.lag("gone").over(w), F.lit(False)) & ~F.col("gone")
    allowed = F.lag("bridge_allowed").over(w) | F.col("bridge_allowed")
    blocked = F.lag("bridge_blocked").over(w) | F.col("bridge_blocked")
    too_far = (F.col("gap") > limit) & (~allowed | (F.col("gap") > limit * 4.0))
    m = marked.withColumns({"rejected": joined & (blocked | too_far), "accepted": joined & ~(blocked | too_far) & (F.col("gap") > start), "blocked_": joined & blocked})
    count = lambda c: F.sum(F.col(c).cast("long")) if isinstance(c, str) else F.sum(c.cast("long"))
    return m.agg(
        F.count(F.lit(1)).alias("nodes"),
        count("flow_blocked").alias("no_flow_blocks"),
        count(low & ~F.col("flow_blocked")).alias("low_confidence"),
        count("accepted").alias("accepted_bridges"),
        count("rejected").alias("rejected_gaps"),
        count("blocked_").alias("blocked_bridges"),
        F.max(F.when(F.col("accepted"), F.col("gap"))).alias("max_accepted"),
        F.min(F.when(F.col("rejected"), F.col("gap"))).alias("min_rejected"),
    )


def fill_gaps(anchors: DataFrame) -> DataFrame:
    """Surface z where the projection missed (surface_z null): copied at the ends, by distance between known ones inside."""
    w = _path()
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("surface_z").isNotNull(), F.struct(F.col("path_distance").alias("d"), F.col("surface_z").alias("z")))
    out = anchors.withColumn("known", known).withColumns({"p": F.last("known", True).over(back), "n": F.first("known", True).over(ahead)})
    t = (F.col("path_distance") - F.col("p.d")) / F.greatest(F.col("n.d") - F.col("p.d"), F.lit(1e-9))
    filled = F.coalesce("surface_z", S.lerp(F.col("p.z"), F.col("n.z"), t), "p.z", "n.z", "z")
    one_side = F.col("p").isNull() | F.col("n").isNull()
    keep = F.when(F.col("surface_z").isNotNull(), 1.0).when(one_side, 0.90).otherwise(0.92)
    return out.withColumns({"z": filled, "confidence": F.col("confidence") * keep}).drop("known", "p", "n")


def prefix_sums(rows: DataFrame, columns: Sequence[str], key: Sequence[str] = ("path_id",)) -> DataFrame:
    """Running sums along each path."""
    w = _path(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"sum_{c}": F.sum(c).over(w) for c in columns})


def timing_knots(keys: DataFrame, fps: int = S.TIMEBASE) -> DataFrame:
    """The second at which each key of a path begins: durations (frames) of the keys before it."""
    w = _path().rowsBetween(Window.unboundedPreceding, -1)
    return keys.withColumn("knot", F.coalesce(F.sum("duration").over(w), F.lit(0)) / float(fps))


def apportion(weights: DataFrame, total: int | Column, key: Sequence[str] = ("path_id",), order: str = "seq") -> DataFrame:
    """One frame for each segment and the rest by weight: floors first, then the largest remainders, earlier ones first.

    Without any weight the rest is dealt evenly, earlier segments first.
    """
    group = Window.partitionBy(*key)
    w = F.greatest(F.col("weight"), F.lit(0.0))
    n = F.count(F.lit(1)).over(group)
    total = F.lit(total) if isinstance(total, int) else total
    rest = F.greatest(total, n) - n
    # Sums over a window without order can come out in any order of addition; eleven digits are enough and always the same.
    whole = F.round(F.sum(w).over(group), 11)
    share = F.when(whole > 1.1920929e-07, w / whole).otherwise(1.0 / n)
    ideal = F.round(rest * share, 9)
    out = weights.withColumns({"base": F.floor(ideal).cast("long"), "left": ideal - F.floor(ideal), "rest": rest})
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("left").desc(), order))
    leftover = F.col("rest") - F.sum("base").over(group)
    return out.withColumn("frames", (1 + F.col("base") + (place <= leftover).cast("long")).cast("long")).drop("base", "left", "rest")


def slice_frames(frames: DataFrame, first: int, last: int) -> DataFrame:
    """An inclusive range of frames; last 0 is the end."""
    kept = frames.where(F.col("frame") >= first)
    return kept.where(F.col("frame") <= last) if last else kept


def fill_ids(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows (seq, id) without an id get prefix + the least numbers not in use, in order."""
    missing = rows.where(F.col("id").isNull())
    used = rows.where(F.col("id").startswith(prefix)).select(F.substring("id", len(prefix) + 1, 18).cast("long").alias("n")).where(F.col("n") > 0).distinct()
    total = rows.count()
    free = rows.sparkSession.range(1, total + 1).toDF("n").join(used, "n", "left_anti")
    new = sampling.ranked(missing, ["seq"]).join(sampling.ranked(free, ["n"]), "rank").select("seq", F.concat(F.lit(prefix), F.col("n").cast("string")).alias("id"))
    return rows.where(F.col("id").isNotNull()).select("seq", "id").unionByName(new)


def segment_weights(shots: DataFrame) -> DataFrame:
    """Weight of the way to the next shot: |move| + |target move| / 4 + turn (2 acos |q . q'|); the last has none."""
    w = _path()
    nxt = lambda c: F.lead(c).over(w)
    move = F.sqrt(reduce(lambda a, b: a + b, [(nxt(c) - F.col(c)) * (nxt(c) - F.col(c)) for c in AXES]))
    target = F.sqrt(reduce(lambda a, b: a + b, [(nxt(f"t{c}") - F.col(f"t{c}")) * (nxt(f"t{c}") - F.col(f"t{c}")) for c in AXES]))
    turn = 2.0 * F.acos(S.clamp(F.abs(reduce(lambda a, b: a + b, [nxt(f"q{c}") * F.col(f"q{c}") for c in "xyzw"]))))
    return shots.withColumn("weight", move + 0.25 * target + turn).where(F.col("weight").isNotNull())


def expand_frames(segments: DataFrame) -> DataFrame:
    """For each segment (path_id, seq, frames, ...) its frames with their place 0..1, and a last frame at the end of each path."""
    w = Window.partitionBy("path_id").orderBy("seq")
    numbered = segments.withColumns({"begin": F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "is_last": F.lead("seq").over(w).isNull()})
    steps = numbered.withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1 + F.col("is_last").cast("long"))))
    return steps.withColumns({"frame": (F.col("begin") + F.col("f")).cast("long"), "t": F.col("f") / F.col("frames")}).drop("begin", "is_last", "f")


def still_frames(state: DataFrame, seconds: float, fps: int) -> DataFrame:
    """ceil(max(0.001, s) fps) copies."""
    import math

    n = math.ceil(round(max(0.001, seconds) * fps, 6))
    return state.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def natural_spline(knots: Sequence[float], values: Sequence[float]) -> np.ndarray:
    """Second derivatives at the knots of the natural cubic spline; a straight line for fewer than three."""
    x, y = np.asarray(knots, float), np.asarray(values, float)
    n = len(x)
    if n < 3:
        return np.zeros(n)
    h = np.diff(x)
    system, right = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    return np.linalg.solve(system, right)


def spline_column(t: Column, knots: Sequence[float], values: Sequence[float]) -> Column:
    """The spline at t, clamped to the ends; the driver solves it, the column is one polynomial a segment."""
    if len(knots) == 1:
        return F.lit(float(values[0]))
    m = natural_spline(knots, values)
    t = S.clamp(t, float(knots[0]), float(knots[-1]))
    out = None
    for i in reversed(range(len(knots) - 1)):
        x0, x1, y0, y1 = float(knots[i]), float(knots[i + 1]), float(values[i]), float(values[i + 1])
        h = max(x1 - x0, 1e-9)
        b = (y1 - y0) / h - h * (2 * m[i] + m[i + 1]) / 6
        u = t - x0
        piece = y0 + u * (float(b) + u * (float(m[i]) / 2 + u * float(m[i + 1] - m[i]) / (6 * h)))
        out = piece if out is None else F.when(t < x1, piece).otherwise(out)
    return out


def evaluate_path(times: DataFrame, keys: Sequence[dict], columns: Sequence[str]) -> DataFrame:
    """Each column of the keys (with ``knot``) as a spline over ``t``; quaternion columns are made one-signed and normalised."""
    knots = [k["knot"] for k in keys]
    quaternion = [c for c in ("qx", "qy", "qz", "qw") if c in columns]
    signed = [dict(k) for k in keys]
    for a, b in zip(signed, signed[1:]):
        if quaternion and sum(a[c] * b[c] for c in quaternion) < 0:
            b.update({c: -b[c] for c in quaternion})
    out = times.withColumns({c: spline_column(F.col("t"), knots, [k[c] for k in signed]) for c in columns})
    if quaternion:
        n = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in quaternion]))
        out = out.withColumn("qn", n).withColumns({c: F.col(c) / F.col("qn") for c in quaternion}).drop("qn")
    return out


def slerp(a: Sequence[Column], b: Sequence[Column], t: Column) -> tuple[Column, ...]:
    """The shorter way between two unit quaternions; nearly equal ones are blended and normalised."""
    d = S.dot(a, b)
    b = [F.when(d < 0, -x).otherwise(x) for x in b]
    d = S.clamp(F.abs(d))
    angle = F.acos(d)
    close = d > 0.9995
    sin = F.when(close, 1.0).otherwise(F.sin(angle))
    p = F.when(close, 1.0 - t).otherwise(F.sin((1.0 - t) * angle) / sin)
    q = F.when(close, t).otherwise(F.sin(t * angle) / sin)
    mixed = [x * p + y * q for x, y in zip(a, b)]
    n = F.sqrt(S.dot(mixed, mixed))
    return tuple(m / n for m in mixed)


def shot_between(pairs: DataFrame) -> DataFrame:
    """Shots (a_*, b_*, t): position, target and fov blended, orientation by slerp."""
    t = F.col("t")
    flat = {c: S.lerp(F.col(f"a_{c}"), F.col(f"b_{c}"), t) for c in ("x", "y", "z", "tx", "ty", "tz", "fov") if f"a_{c}" in pairs.columns}
    turn = slerp([F.col(f"a_q{c}") for c in "xyzw"], [F.col(f"b_q{c}") for c in "xyzw"], t)
    return pairs.withColumns(flat | {f"q{c}": v for c, v in zip("xyzw", turn)})


def motion_stats(spark, keys: Sequence[dict], samples: int = 240) -> DataFrame:
    """Way of camera and target over ``samples`` steps of the path, seconds, and mean speed."""
    end = float(keys[-1]["knot"])
    times = spark.range(samples + 1).select(F.col("id").alias("seq"), F.lit(0).alias("path_id"), (F.col("id") / samples * end).alias("t"))
    names = [c for c in ("x", "y", "z", "tx", "ty", "tz") if c in keys[0]]
    at = evaluate_path(times, keys, names)
    w = _path()
    steps = at.select(step_length(w).alias("camera"), (step_length(w, ("tx", "ty", "tz")) if "tx" in names else F.lit(0.0)).alias("target"))
    return steps.agg(F.sum("camera").alias("camera_distance"), F.sum("target").alias("target_distance")).withColumns({"seconds": F.lit(end), "speed": F.col("camera_distance") / max(end, 1e-9)})


def node_order(nodes: DataFrame) -> DataFrame:
    """O1: nodes by station, y and x, rounded to 1e-5 (a tolerance in a comparison is no order), stations from 0."""
    w = Window.partitionBy("path_id").orderBy(F.round("station", 5), F.round("y", 5), "x", "point_index")
    first = F.first("station").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return nodes.withColumns({"seq": F.row_number().over(w) - 1, "first": first}).withColumn("station", F.col("station") - F.col("first")).drop("first")


def camera_keys(shots: DataFrame) -> DataFrame:
    """Shots in order as path keys with running ids."""
    w = Window.partitionBy("path_id").orderBy("seq")
    return shots.withColumn("key_id", F.row_number().over(w).cast("long"))


def import_durations(samples: DataFrame) -> DataFrame:
    """SRC28: durations of imported camera samples (path_id, frame): frames to the next one."""
    w = Window.partitionBy("path_id").orderBy("frame")
    return samples.withColumn("duration", F.coalesce(F.lead("frame").over(w) - F.col("frame"), F.lit(0)))
