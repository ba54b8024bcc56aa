"""Pictures from points: samples exploded into pixels and aggregated."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S

#: Largest sprite radius in pixels.
MOST_RADIUS = 32
RGB = ("r", "g", "b")


def project(points: DataFrame, view_projection: Sequence[float], width: int, height: int, *, near: float = 0.0, far: float = float("inf"), sprites: bool = True) -> DataFrame:
    """Pixel place (px, py) and depth of each point in view.  depth is clip w; sprites outside the picture's depth cube go."""
    c = S.clip(S.vec("x", "y", "z"), view_projection)
    px, py = S.to_pixel(c, width, height)
    kept = points.withColumns({"px": px, "py": py, "depth": c[3], "ndc_z": c[2] / F.when(c[3] > 1e-6, c[3])})
    kept = kept.where(F.col("px").isNotNull() & (F.col("depth") > near) & (F.col("depth") < far))
    return (kept.where(F.abs(F.col("ndc_z")) <= 1) if sprites else kept).drop("ndc_z")


def cover(samples: DataFrame, width: int, height: int) -> DataFrame:
    """A row for each pixel (ix, iy) whose centre lies within ``radius`` of the sample; ``reach`` is that distance over the radius.

    The offsets come from a sequence sized by the row's own radius, so small sprites make few rows.
    """
    r = F.least(F.greatest(F.col("radius"), F.lit(0.5)), F.lit(float(MOST_RADIUS)))
    lo = lambda c: F.floor(F.col(c) - r - 0.5).cast("int")
    hi = lambda c: F.ceil(F.col(c) + r - 0.5).cast("int")
    grid = samples.withColumn("iy", F.explode(F.sequence(lo("py"), hi("py")))).where(F.col("iy").between(0, height - 1))
    grid = grid.withColumn("ix", F.explode(F.sequence(lo("px"), hi("px")))).where(F.col("ix").between(0, width - 1))
    dx, dy = F.col("ix") + 0.5 - F.col("px"), F.col("iy") + 0.5 - F.col("py")
    return grid.withColumn("reach", F.sqrt(dx * dx + dy * dy) / r).where(F.col("reach") <= 1)


def pixel_of(samples: DataFrame, width: int, height: int) -> DataFrame:
    """The one pixel that holds each sample."""
    cell = samples.withColumns({"ix": F.floor("px").cast("int"), "iy": F.floor("py").cast("int"), "reach": F.lit(0.0)})
    return cell.where(F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1))


def depth_test(fragments: DataFrame) -> DataFrame:
    """For each pixel the nearest fragment's colour; on ties the earlier draw (layer, point_index)."""
    best = F.min(F.struct("depth", "layer", "point_index", *RGB)).alias("k")
    return fragments.groupBy("ix", "iy").agg(best).select("ix", "iy", "k.depth", "k.layer", "k.point_index", *[F.col(f"k.{c}").alias(c) for c in RGB])


def depth_prepass(fragments: DataFrame, threshold: float = 0.5, mode: str = "threshold") -> DataFrame:
    """The least depth of each pixel's fragments that write depth."""
    writes = S.alpha_writes_depth(mode, F.col("alpha"), threshold)
    return fragments.groupBy("ix", "iy").agg(F.min(F.when(writes, F.col("depth"))).alias("scene_depth"))


def accumulate(fragments: DataFrame, *, near: float, far: float) -> DataFrame:
    """Sums of weighted colour and alpha, the product of what shines through, and emission; partial per task.

    Normals and albedo, where the fragments have them, are summed with the same weights (R17).
    """
    depth01 = S.clamp((F.col("depth") - near) / max(far - near, 1e-9))
    w = S.oit_weight(F.col("alpha"), depth01)
    extra = [c for c in ("nx", "ny", "nz", "ar", "ag", "ab") if c in fragments.columns]
    weighted = fragments.withColumn("w", w * F.col("alpha"))
    emission = [F.sum(F.col(f"e{c}")).alias(f"e{c}") for c in RGB if f"e{c}" in fragments.columns]
    return weighted.groupBy("ix", "iy").agg(
        *[F.sum(F.col(c) * F.col("w")).alias(c) for c in (*RGB, *extra)],
        F.sum("w").alias("w"),
        F.product(1.0 - F.col("alpha")).alias("through"),
        F.min("depth").alias("depth"),
        *emission,
    )


def composite(sums: DataFrame, background: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Alpha is what does not shine through; colour is the weighted mean, plus emission 1 - e^-sum, over the background."""
    alpha = 1.0 - F.col("through")
    out = {}
    for c, back in zip(RGB, background):
        own = F.col(c) / F.greatest(F.col("w"), F.lit(1e-6))
        glow = 1.0 - F.exp(-F.col(f"e{c}")) if f"e{c}" in sums.columns else F.lit(0.0)
        out[c] = own * alpha + glow + back * (1.0 - alpha)
    return sums.withColumns(out | {"alpha": alpha}).select("ix", "iy", *RGB, "alpha", "depth")


def render(points: DataFrame, view_projection: Sequence[float], width: int, height: int, *, near: float = 0.01, far: float = 1000.0, radius: Column | float = 1.0, alpha: Column | float = 1.0, profile: str = "hard", mode: str = "beauty", xray: dict | None = None) -> DataFrame:
    """A picture of points with columns x, y, z, r, g, b, layer and point_index.

    fast: depth test only.  beauty: weighted blending.  The depth prepass is joined in only where x-ray asks for it (R8: what a style does not need is
    not planned).  Pixels are the key throughout, so tiles (R2) are just a coarser partitioning of the same rows.
    """
    samples = project(points, view_projection, width, height, near=near, far=far).withColumn("radius", S.col(radius))
    fragments = cover(samples, width, height).withColumn("alpha", S.clamp(S.col(alpha) * S.falloff(F.col("reach"), profile))).where(F.col("alpha") > 0)
    if mode == "fast":
        return depth_test(fragments)
    if xray:
        scene = depth_prepass(fragments)
        fragments = fragments.join(scene, ["ix", "iy"], "left").withColumn("alpha", F.col("alpha") * S.xray_alpha(F.col("depth"), F.col("scene_depth"), **xray)).drop("scene_depth")
    return composite(accumulate(fragments, near=near, far=far))


def tiles(width: int, height: int, size: int = 512) -> list[tuple[int, int, int, int]]:
    """R2: (x, y, width, height) of each tile, row by row."""
    return [(x, y, min(size, width - x), min(size, height - y)) for y in range(0, height, size) for x in range(0, width, size)]


def surfel_hits(surfels: DataFrame, rays: DataFrame) -> DataFrame:
    """Where pixel rays (ix, iy, o*, d*) of a surfel's box meet its plane within its ellipse.

    surfels: point_index, x, y, z, n*, u*, v* (basis), ru, rv (radii), ix0, ix1, iy0, iy1 (box).  A ray joins the surfels whose box holds its pixel.
    """
    boxed = surfels.withColumn("iy", F.explode(F.sequence("iy0", "iy1"))).withColumn("ix", F.explode(F.sequence("ix0", "ix1")))
    both = boxed.join(rays, ["ix", "iy"])
    n, d = S.vec("nx", "ny", "nz"), S.vec("dx", "dy", "dz")
    to = (F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("z") - F.col("oz"))
    facing = S.dot(n, d)
    t = S.dot(n, to) / F.when(F.abs(facing) > 1e-6, facing)
    at = tuple(t * k - p for k, p in zip(d, to))
    a, b = S.dot(at, S.vec("ux", "uy", "uz")) / F.col("ru"), S.dot(at, S.vec("vx", "vy", "vz")) / F.col("rv")
    return both.withColumns({"depth": t, "reach": F.sqrt(a * a + b * b)}).where((F.col("depth") > 0) & (F.col("reach") <= 1)).select("point_index", "ix", "iy", "depth", "reach")


def surfel_basis(df: DataFrame, normal: S.Vec, preferred: Sequence[float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """Df with two unit vectors u_* and v_* across a normal; the first leans to the preferred tangent unless that is the normal itself.

    Each step is staged: written out in one expression, a component of v has hundreds of thousands of terms.
    """
    df = S.staged(df, _n=S.normalise(normal, fallback=(0.0, 0.0, 1.0)))
    n = S.at("_n")
    parallel = F.abs(S.dot(n, preferred)) > 0.99
    df = S.staged(df, _o=tuple(F.when(parallel, o).otherwise(p) for o, p in zip((0.0, 1.0, 0.0), map(float, preferred))))
    df = df.withColumn("_k", S.dot(n, S.at("_o")))
    df = S.staged(df, _t=tuple(o - m * F.col("_k") for o, m in zip(S.at("_o"), n)))
    df = S.staged(df, u=S.normalise(S.at("_t"), 1e-12, (1.0, 0.0, 0.0)))
    return S.unstaged(S.staged(df, v=S.cross(n, S.at("u"))), "_n", "_o", "_t").drop("_k")


# Filters over pixels: a pixel is sent to the neighbours it matters to, and each pixel aggregates what it gets.


def _spread(pixels: DataFrame, offsets: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Copies of ``columns`` (as n_*) at each offset (dx, dy, weight) from their pixel."""
    o = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for dx, dy, w in offsets])
    sent = pixels.select("ix", "iy", *[F.col(c).alias(f"n_{c}") for c in columns], F.explode(o).alias("o"))
    # Its size is estimated without the copies: small enough to send whole to all tasks, the driver would hold them.
    return sent.hint("merge").select((F.col("ix") - F.col("o.dx")).alias("ix"), (F.col("iy") - F.col("o.dy")).alias("iy"), F.col("o.w").alias("ring"), F.sqrt((F.col("o.dx") * F.col("o.dx") + F.col("o.dy") * F.col("o.dy")).cast("double")).alias("distance"), *[f"n_{c}" for c in columns])


def ring_offsets(thickness: float) -> list[tuple[int, int, float]]:
    """Eight neighbours at each radius up to the thickness, the outermost ring by what is left of it."""
    limit = min(24.0, max(0.0, thickness))
    out = []
    for radius in range(1, math.ceil(limit) + 1):
        weight = min(1.0, max(0.0, limit - (radius - 1)))
        if weight > 1e-6:
            out += [(dx * radius, dy * radius, weight) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    return out


def eye_dome(pixels: DataFrame, thickness: float = 1.0, strength: float = 1.0, least: float = 0.35) -> DataFrame:
    """Each pixel's shade: e^(-strength * mean rise of log depth around it), between ``least`` and 1.

    Pixels without a depth neither shade nor are shaded.
    """
    known = pixels.where(S.is_finite(F.col("depth")) & (F.col("depth") > 0)).select("ix", "iy", F.log2(F.greatest(F.col("depth"), F.lit(1e-6))).alias("log_depth"))
    offsets = ring_offsets(thickness)
    if not offsets:
        return pixels.withColumn("shade", F.lit(1.0))
    rises = _spread(known, offsets, ["log_depth"]).join(known, ["ix", "iy"])
    shade = rises.groupBy("ix", "iy").agg(F.sum(F.greatest(F.col("n_log_depth") - F.col("log_depth"), F.lit(0.0)) * F.col("ring")).alias("rise"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("rise") > 1e-6, S.clamp(F.exp(-max(0.0, strength) * F.col("rise") / F.col("n")), least, 1.0)).otherwise(1.0)
    return pixels.join(shade.select("ix", "iy", value.alias("shade")), ["ix", "iy"], "left").withColumn("shade", F.coalesce("shade", F.lit(1.0)))


def fill_sparse(pixels: DataFrame, radius: int = 1, *, threshold: float = 0.0, fill: float = 1.0, covered: float = 0.0, absolute: float = 0.05, relative: float = 0.02) -> DataFrame:
    """Pixels mixed with the alpha / (1 + distance) weighted mean of their covered neighbours.

    An empty pixel by ``fill``, a covered one with other covered ones of like depth near it by ``covered``.  Alpha stays.
    """
    radius = min(4, radius)
    square = [(dx, dy, 1.0) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    sent = _spread(pixels.where(F.col("alpha") > threshold), square, ["alpha", *RGB, "depth"])
    both = pixels.join(sent, ["ix", "iy"])
    is_covered = F.col("alpha") > threshold
    both = both.where(~is_covered | S.depth_compatible(F.col("depth"), F.col("n_depth"), absolute, relative))
    w = F.col("n_alpha") / (1.0 + F.col("distance"))
    near = both.groupBy("ix", "iy").agg(F.sum(w).alias("near_w"), F.count(F.lit(1)).alias("near_n"), *[F.sum(F.col(f"n_{c}") * w).alias(f"near_{c}") for c in RGB])
    out = pixels.join(near, ["ix", "iy"], "left")
    share = F.when(F.coalesce(F.col("near_w"), F.lit(0.0)) <= 1e-6, 0.0).when(~is_covered, fill).when(F.col("near_n") > 1, covered).otherwise(0.0)
    return out.withColumns({c: F.when(share > 0, S.lerp(F.col(c), F.col(f"near_{c}") / F.col("near_w"), share)).otherwise(F.col(c)) for c in RGB}).drop("near_w", "near_n", *[f"near_{c}" for c in RGB])


def downsample(pixels: DataFrame, width: int, height: int, out_width: int, out_height: int) -> DataFrame:
    """Mean alpha, alpha-weighted colour and depth of the pixels that each output pixel touches; one on an edge counts in both.

    Missing pixels are empty ones: the mean is over all pixels of the box.
    """
    if (width, height) == (out_width, out_height):
        return pixels

    def first(n: int, out: int, i: Column) -> Column:
        return F.least(F.floor(i * (n / out)), F.lit(n - 1)).cast("int")

    def last(n: int, out: int, i: Column) -> Column:
        return F.least(F.greatest(F.ceil((i + 1) * (n / out)), F.lit(1)), F.lit(n)).cast("int")

    def cells(i: Column, n: int, out: int) -> Column:
        """Outputs that may touch pixel i: computed with slack, then tested by the rule itself."""
        lo, hi = F.floor(i * out / n).cast("int") - 1, F.floor((i + 1) * out / n).cast("int") + 1
        return F.filter(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(out - 1))), lambda o: (first(n, out, o) <= i) & (i < last(n, out, o)))

    sent = pixels.withColumn("oy", F.explode(cells(F.col("iy"), height, out_height))).withColumn("ox", F.explode(cells(F.col("ix"), width, out_width)))
    known = S.is_finite(F.col("depth")) & (F.col("depth") > 0)
    dw = F.when(known, F.greatest(F.col("alpha"), F.lit(0.001)))
    sums = sent.groupBy("ox", "oy").agg(F.sum("alpha").alias("a"), *[F.sum(F.col(c) * F.col("alpha")).alias(c) for c in RGB], F.sum(dw * F.col("depth")).alias("d"), F.sum(dw).alias("dw"))
    n = (last(width, out_width, F.col("ox")) - first(width, out_width, F.col("ox"))) * (last(height, out_height, F.col("oy")) - first(height, out_height, F.col("oy")))
    colour = {c: F.when(F.col("a") > 1e-6, F.col(c) / F.col("a")).otherwise(0.0) for c in RGB}
    return sums.withColumns(colour | {"alpha": S.clamp(F.col("a") / n), "depth": F.coalesce(F.col("d") / F.col("dw"), F.lit(0.0))}).select(F.col("ox").alias("ix"), F.col("oy").alias("iy"), *RGB, "alpha", "depth")


def display_bytes(pixels: DataFrame) -> DataFrame:
    """sRGB bytes; alpha is not curved."""
    return pixels.withColumns({c: S.to_byte(S.linear_to_srgb(F.col(c))) for c in RGB} | {"alpha": S.to_byte(F.col("alpha"))})


def full_image(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Every pixel, with what is missing empty and infinitely deep."""
    grid = pixels.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("ix"), F.floor(F.col("id") / width).cast("int").alias("iy"))
    out = grid.join(pixels, ["ix", "iy"], "left")
    return out.fillna(0.0, [*RGB, "alpha"]).withColumn("depth", F.coalesce("depth", F.lit(float("inf"))))


def diagnostics(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Points seen, pixels covered, and points of each layer."""
    seen = points.groupBy("layer").agg(F.count(F.lit(1)).alias("points"))
    return seen.join(F.broadcast(pixels.agg(F.count(F.lit(1)).alias("covered"))))


def last_covering(fragments: DataFrame) -> DataFrame:
    """The front-to-back order of each pixel's fragments, for modes that blend in order."""
    return fragments.withColumn("order", F.row_number().over(Window.partitionBy("ix", "iy").orderBy("depth", "layer", "point_index")))


def blend_over(fragments: DataFrame) -> DataFrame:
    """Front-to-back ``over`` of each pixel's fragments: each counts by what those before it let through.

    The fold becomes a sum: what is let through is the exponential of a running sum of log(1 - alpha).
    """
    w = Window.partitionBy("ix", "iy").orderBy("depth", "layer", "point_index").rowsBetween(Window.unboundedPreceding, -1)
    a = F.least(F.col("alpha"), F.lit(0.999999))
    through = F.exp(F.coalesce(F.sum(F.log1p(-a)).over(w), F.lit(0.0)))
    parts = fragments.withColumn("part", a * through)
    return parts.groupBy("ix", "iy").agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in RGB], F.sum("part").alias("alpha"), F.min("depth").alias("depth"))


def sum_columns(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
