"""Gaussian splats: decoding, spherical-harmonic colour, projected footprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S

# Constants of the real spherical harmonics up to degree 3.
C0 = 0.28209479177387814
C1 = 0.4886025119029199
C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
C3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def decode(raw: DataFrame) -> DataFrame:
    """SRC7, E20-E22: stored opacity, scale[3] and rot[4] (w, x, y, z) made usable."""
    q = S.unit_quaternion([F.col("rot")[i] for i in range(4)])
    return raw.withColumns({"opacity": S.opacity(F.col("opacity")), "scale": F.transform("scale", S.scale), "rot": F.array(*q)})


def to_world(splats: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """Centres under a 4 x 4 transform."""
    return splats.withColumns(dict(zip(("x", "y", "z"), S.affine(S.vec("x", "y", "z"), matrix))))


def basis(d: S.Vec) -> list[Column]:
    """The 16 harmonics in a direction."""
    x, y, z = d
    xx, yy, zz = x * x, y * y, z * z
    return [
        F.lit(C0),
        -C1 * y, C1 * z, -C1 * x,
        C2[0] * x * y, C2[1] * y * z, C2[2] * (2.0 * zz - xx - yy), C2[3] * x * z, C2[4] * (xx - yy),
        C3[0] * y * (3.0 * xx - yy), C3[1] * x * y * z, C3[2] * y * (4.0 * zz - xx - yy), C3[3] * z * (2.0 * zz - 3.0 * xx - 3.0 * yy),
        C3[4] * x * (4.0 * zz - xx - yy), C3[5] * z * (xx - yy), C3[6] * x * (xx - 3.0 * yy),
    ]


def sh_colour(sh: Column, d: S.Vec, bands: int = 16) -> tuple[Column, Column, Column]:
    """Colour of ``sh`` (first three: band 0 of r, g, b; then 15 of r, of g, of b) in a direction; one band is the flat colour."""
    b = basis(d)
    out = []
    for c in range(3):
        total = b[0] * sh[c]
        for k in range(1, bands):
            total = total + b[k] * sh[3 + 15 * c + k - 1]
        out.append(F.greatest(total + 0.5, F.lit(0.0)))
    return tuple(out)


def rotation(q: Sequence[Column]) -> list[list[Column]]:
    """The matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y)],
        [2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x)],
        [2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y)],
    ]


def footprint(splats: DataFrame, view: Sequence[float], focal: float, *, blur: Column | float = 0.3) -> DataFrame:
    """The ellipse of each splat on the picture: covariance R S S R^T projected at its view place, plus a blur.

    Added: cov_xx, cov_xy, cov_yy, radius_major, radius_minor (square roots of the closed-form eigenvalues), view_depth.
    """
    m = [float(v) for v in view]
    r = rotation([F.col("rot")[i] for i in range(4)])
    scaled = [[r[i][k] * F.col("scale")[k] for k in range(3)] for i in range(3)]
    p = S.affine(S.vec("x", "y", "z"), m)
    out = splats.withColumns({f"v{a}": c for a, c in zip("xyz", p)} | {f"s{i}{k}": scaled[i][k] for i in range(3) for k in range(3)})
    depth = F.greatest(-F.col("vz"), F.lit(1e-4))
    # rows of the Jacobian of the projection times the view rotation
    jac = [[focal * m[k] / depth + focal * F.col("vx") / (depth * depth) * m[8 + k] for k in range(3)], [focal * m[4 + k] / depth + focal * F.col("vy") / (depth * depth) * m[8 + k] for k in range(3)]]
    t = [[sum((jac[a][i] * F.col(f"s{i}{k}") for i in range(1, 3)), jac[a][0] * F.col(f"s0{k}")) for k in range(3)] for a in range(2)]
    xx, xy, yy = (sum((t[a][k] * t[b][k] for k in range(1, 3)), t[a][0] * t[b][0]) for a, b in ((0, 0), (0, 1), (1, 1)))
    out = out.withColumns({"cov_xx": xx + S.col(blur), "cov_xy": xy, "cov_yy": yy + S.col(blur), "view_depth": depth}).drop(*[f"v{a}" for a in "xyz"], *[f"s{i}{k}" for i in range(3) for k in range(3)])
    mid = 0.5 * (F.col("cov_xx") + F.col("cov_yy"))
    half = F.sqrt(F.greatest(0.25 * (F.col("cov_xx") - F.col("cov_yy")) * (F.col("cov_xx") - F.col("cov_yy")) + F.col("cov_xy") * F.col("cov_xy"), F.lit(0.0)))
    return out.withColumns({"radius_major": F.sqrt(mid + half), "radius_minor": F.sqrt(F.greatest(mid - half, F.lit(0.0)))})


def splat_alpha(opacity: Column, dx: Column, dy: Column, xx: Column, xy: Column, yy: Column) -> Column:
    """Opacity times e^(-d^T C^-1 d / 2), 0 below 1 / 255."""
    det = F.greatest(xx * yy - xy * xy, F.lit(1e-12))
    power = (yy * dx * dx - 2.0 * xy * dx * dy + xx * dy * dy) / det
    a = opacity * F.exp(-0.5 * power)
    return F.when(a >= 1 / 255, F.least(a, F.lit(0.99))).otherwise(0.0)


def focus_blur(depth: Column, focus: float, aperture: float, focal: float) -> Column:
    """Radius in pixels of the circle of confusion."""
    return F.abs(depth - focus) / F.greatest(depth, F.lit(1e-4)) * aperture * focal


def debug_colour(mode: str, splats: DataFrame) -> DataFrame:
    """R, g, b by mode: opacity, scale or depth in place of the colour."""
    grey = {"opacity": F.col("opacity"), "scale": S.clamp(F.array_max("scale")), "depth": S.clamp(F.col("view_depth") / 100.0)}.get(mode)
    return splats if grey is None else splats.withColumns({c: grey for c in "rgb"})
