"""Scalar expressions over columns: bindings, curves, hashes, geometry, camera arithmetic.

Everything is a ``Column`` made of built-in functions, so it stays in whole-stage code generation.  Numbers are doubles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Number, lo: Number = 0.0, hi: Number = 1.0) -> Column:
    return F.least(F.greatest(col(x), col(lo)), col(hi))


def lerp(a: Number, b: Number, t: Number) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def fract(x: Number) -> Column:
    return col(x) - F.floor(col(x))


def smoothstep(lo: Number, hi: Number, x: Number) -> Column:
    """E55, guarded: a width below 1e-6 counts as 1e-6."""
    t = clamp((col(x) - col(lo)) / F.greatest(col(hi) - col(lo), F.lit(1e-6)))
    return t * t * (3.0 - 2.0 * t)


def smoothstep_any(lo: Number, hi: Number, x: Number) -> Column:
    """E55, a step where the edges meet; the edges may be reversed."""
    width = col(hi) - col(lo)
    t = clamp((col(x) - col(lo)) / F.when(F.abs(width) < 1e-6, F.lit(1.0)).otherwise(width))
    return F.when(F.abs(width) < 1e-6, F.when(col(x) < col(lo), 0.0).otherwise(1.0)).otherwise(t * t * (3.0 - 2.0 * t))


def is_finite(x: Column) -> Column:
    """F14 for one component."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


# Bindings: a constant, or a field mapped from an input to an output range.

CLAMP, INVERT, LAYER_STATS = 1, 2, 4
#: E3, and the narrowest input range.
LEAST_GAMMA, LEAST_RANGE = 1e-4, 1e-5
#: What inactive bindings stand for.
INACTIVE = {"point_size": 1.0, "surfel_diameter": 0.005, "opacity": 1.0, "emission": 0.0, "xray": 0.0, "depth_fade": 0.0, "colormap_position": 0.5}


@dataclass(frozen=True)
class Binding:
    """A value for each point: ``constant``, or ``field`` mapped with gamma from [lo, hi] to [out_lo, out_hi]."""

    constant: float = 0.0
    field: str | None = None
    lo: float = 0.0
    hi: float = 1.0
    out_lo: float = 0.0
    out_hi: float = 1.0
    gamma: float = 1.0
    flags: int = CLAMP | LAYER_STATS
    active: bool = True


@dataclass(frozen=True)
class Stats:
    """Range of a field."""

    lo: float = 0.0
    hi: float = 0.0
    valid: bool = True


def input_range(b: Binding, stats: Stats | None) -> tuple[float, float]:
    """The layer's range if there is one and the binding asks for it."""
    return (stats.lo, stats.hi) if stats is not None and stats.valid and b.flags & LAYER_STATS else (b.lo, b.hi)


def configure(b: Binding, field: str, stats: Stats | None) -> Binding:
    """E5: map ``field`` over its range, or 0..1 without one."""
    known = stats is not None and stats.valid
    return replace(b, field=field, lo=stats.lo if known else 0.0, hi=stats.hi if known else 1.0, gamma=1.0, flags=CLAMP | LAYER_STATS)


def resolve_field(columns: Sequence[str], slot: int, name: str) -> str | None:
    """The field at ``slot``, else the one of that name, else none."""
    return columns[slot] if 0 <= slot < len(columns) else name if name in columns else None


def field_value(columns: Sequence[str], name: str | None) -> Column:
    """The field, 0 where it is missing."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)


def evaluate(b: Binding, value: Column | None = None, stats: Stats | None = None) -> Column:
    """The binding's value.  A constant folds away; inversion comes before the clamp."""
    if b.field is None:
        return F.lit(float(b.constant))
    lo, hi = input_range(b, stats)
    return mapped(col(b.field) if value is None else value, F.lit(lo), F.lit(hi), b)


def mapped(value: Column, lo: Column, hi: Column, b: Binding) -> Column:
    """E1 with the input range as columns."""
    n = (value - lo) / F.greatest(hi - lo, F.lit(LEAST_RANGE))
    if b.flags & INVERT:
        n = 1.0 - n
    gamma = max(LEAST_GAMMA, b.gamma)
    if b.flags & CLAMP:
        n = clamp(n)
        n = n if gamma == 1 else F.pow(n, F.lit(gamma))
    elif gamma != 1:
        n = F.signum(n) * F.pow(F.abs(n), F.lit(gamma))
    return b.out_lo + (b.out_hi - b.out_lo) * n


def with_default(b: Binding, role: str, stats: Stats | None = None) -> Column:
    """An inactive binding is its role's default."""
    return evaluate(b, stats=stats) if b.active else F.lit(INACTIVE[role])


def inactive_count(bindings: Sequence[Binding]) -> int:
    """A25."""
    return sum(not b.active for b in bindings)


def inactive_count_column(bindings: Column) -> Column:
    """A25 over an array of structs with ``active``."""
    return F.size(F.filter(bindings, lambda b: ~b["active"]))


def normalised(value: Column, lo: Column, hi: Column, valid: Column | None = None) -> Column:
    """Place in the range; 0.5 if the range is flat or unknown."""
    flat = F.abs(hi - lo) <= 1e-6
    flat = flat if valid is None else flat | ~valid
    return F.when(flat, 0.5).otherwise(clamp((value - lo) / F.when(flat, F.lit(1.0)).otherwise(hi - lo)))


# Hashes (E48, E49, E51-E53): whole numbers below 2 ** 32 in longs; a product is split so that it never passes 63 bits.

_LOW = 0xFFFFFFFF


def _mul32(x: Column, k: int) -> Column:
    hi = F.shiftrightunsigned(x, 16) * F.lit(k & 0xFFFF) + x.bitwiseAND(F.lit(0xFFFF)) * F.lit(k >> 16)
    return (F.shiftleft(hi.bitwiseAND(F.lit(0xFFFF)), 16) + x.bitwiseAND(F.lit(0xFFFF)) * F.lit(k & 0xFFFF)).bitwiseAND(F.lit(_LOW))


def _xorshift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, n))


# Shifts and multipliers of the 32-bit hash.
HASH_STEPS = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))


def hash32(x: Column) -> Column:
    """A 32-bit integer hash."""
    h = x.cast("long").bitwiseAND(F.lit(_LOW))
    for shift, k in HASH_STEPS:
        h = _xorshift(h, shift)
        h = h if k is None else _mul32(h, k)
    return h


def hash_unit(x: Column) -> Column:
    """The low 24 bits of the hash as a number in [0, 1]."""
    return hash32(x).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(16777215.0)


def hash32_sql(x: str) -> str:
    """The same hash in DuckDB SQL."""
    h = f"(({x}) & {_LOW})"
    for shift, k in HASH_STEPS:
        h = f"xor({h}, {h} >> {shift})" if k is None else f"((xor({h}, {h} >> {shift})::hugeint * {k}) % 4294967296)::bigint"
    return h


# Odd multipliers that tell layer, point and salt apart.
REGION_FACTORS = (747796405, 2891336453, 277803737)


def region_hash(layer: Column, point: Column, salt: Column) -> Column:
    """32 bits of (layer, point, salt)."""
    parts = [_mul32(x.cast("long").bitwiseAND(F.lit(_LOW)), k) for x, k in zip((layer, point, salt), REGION_FACTORS)]
    return reduce(lambda a, b: a.bitwiseXOR(b), parts)


def cell_noise(cx: Column, cy: Column, seed: Column, salt: int = 0) -> Column:
    """A number in [0, 1] for each cell."""
    return hash_unit(region_hash(cx, cy, seed.cast("long") + F.lit(salt)))


def trig_hash(x: Column) -> Column:
    """fract(sin(x) * 43758.5453123), in doubles; compare with a tolerance only."""
    return fract(F.sin(x) * 43758.5453123)


def block_noise(x: Column, y: Column, seed: Number = 0.0) -> Column:
    """Four lattice values (E52) blended by a cubic fade."""
    ix, iy = F.floor(x), F.floor(y)
    u, v = smoothstep(0.0, 1.0, x - ix), smoothstep(0.0, 1.0, y - iy)
    at = lambda dx, dy: trig_hash((ix + dx) * 127.1 + (iy + dy) * 311.7 + col(seed) * 74.7)
    return lerp(lerp(at(0, 0), at(1, 0), u), lerp(at(0, 1), at(1, 1), u), v)


# Waves (E54, E66) and playback (E84, E85, X1): pure functions of the row and a time.


def wave_peak(phase: Column, power: float) -> Column:
    return F.pow(0.5 + 0.5 * F.cos(2 * math.pi * phase), F.lit(power))


def line(distance: Column, width: Number) -> Column:
    return 1.0 - smoothstep(0.0, width, F.abs(distance))


def linear_ripple(u: Column, wavelength: float, phase: Column) -> Column:
    return wave_peak(u / max(1e-5, wavelength) - phase, 4.0)


def radial_ripple(r: Column, wavelength: float, phase: Column) -> Column:
    return wave_peak(r / max(1e-5, wavelength) - phase, 6.0)


def particle_travel(phase: Column, t: Number, speed: Column) -> Column:
    """How far along its path a particle is."""
    return F.pmod(phase + col(t) * speed * 0.12 + 1.0, F.lit(1.0))


def particle_fade(travel: Column) -> Column:
    """Fades in over the first and out over the last part of the path."""
    return smoothstep(0.0, 0.08, travel) * (1.0 - smoothstep(0.86, 1.0, travel))


def stream_phase(start: Column, stream_age: Column, t: Number, speed: Column, route: Column, point_age: Column, length: Column) -> Column:
    """fract(start + age + t speed / route - point age length / route)."""
    safe = F.greatest(route, F.lit(1e-4))
    return fract(start + stream_age + col(t) * speed / safe - point_age * length / safe)


# Geometry (E20-E28, E71-E76, AR1). Vectors are tuples of three columns.

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n).cast("double") for n in names)


def dot(a: Sequence[Number], b: Sequence[Number]) -> Column:
    return reduce(lambda x, y: x + y, [col(p) * col(q) for p, q in zip(a, b)])


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Sequence[Number]) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vec, least: float = 1e-12, fallback: Sequence[float] = (0.0, 0.0, 0.0)) -> Vec:
    """Unit length; ``fallback`` for what is shorter than the square root of ``least`` or not finite."""
    n2 = dot(a, a)
    ok = is_finite(n2) & (n2 > least)
    n = F.sqrt(F.when(ok, n2).otherwise(1.0))
    return tuple(F.when(ok, x / n).otherwise(f) for x, f in zip(a, fallback))


def grid_key(x: Column, cell: float) -> Column:
    """E75."""
    return F.floor(x / max(1e-4, cell)).cast("long")


def voxel(x: Column, lo: Column, extent: Column, dimension: int) -> Column:
    """Which of ``dimension`` cells of the extent x lies in."""
    if dimension <= 1:
        return F.lit(0).cast("long")
    t = clamp((x - lo) / F.when(extent > 0, extent).otherwise(1.0), 0.0, 0.999999999999)
    return F.when(extent > 0, F.floor(t * dimension)).otherwise(0).cast("long")


def voxel_centre(key: Column, lo: Column, extent: Column, dimension: int) -> Column:
    return lo + 0.5 * extent if dimension <= 1 else lo + (key + 0.5) / dimension * extent


def morton(keys: Sequence[Column], depth: int) -> Column:
    """The bits of x, y, z interleaved from the most significant one."""
    if depth > 21:
        raise ValueError("63 bits hold 21 levels")
    out = F.lit(0).cast("long")
    for bit in reversed(range(depth)):
        for k in keys:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(k.cast("long"), bit).bitwiseAND(F.lit(1)))
    return out


def opacity(x: Column) -> Column:
    """Logistic of the stored value, clamped to +-32."""
    return 1.0 / (1.0 + F.exp(-clamp(x, -32.0, 32.0)))


def scale(x: Column) -> Column:
    """E21."""
    return F.exp(clamp(x, -16.0, 16.0))


def unit_quaternion(q: Sequence[Column]) -> tuple[Column, ...]:
    """(w, x, y, z) of unit length; the identity for what is nearly zero."""
    n2 = dot(q, q)
    ok = n2 > 1.1920929e-07
    n = F.sqrt(F.when(ok, n2).otherwise(1.0))
    return tuple(F.when(ok, x / n).otherwise(d) for x, d in zip(q, (1.0, 0.0, 0.0, 0.0)))


def affine(p: Vec, m: Sequence[float]) -> Vec:
    """The first three rows of a row-major 4 x 4 matrix."""
    return tuple(p[0] * m[4 * r] + p[1] * m[4 * r + 1] + p[2] * m[4 * r + 2] + m[4 * r + 3] for r in range(3))


def transform_normal(n: Vec, m: Sequence[float]) -> Vec:
    """By the inverse transpose of the upper 3 x 3, which the driver inverts."""
    import numpy as np

    it = np.linalg.inv(np.array(m, float).reshape(4, 4)[:3, :3]).T
    return normalise(tuple(dot(n, [float(x) for x in row]) for row in it))


def clip(p: Vec, view_projection: Sequence[float]) -> tuple[Column, Column, Column, Column]:
    """Clip coordinates of a point under a row-major 4 x 4 matrix."""
    m = [float(x) for x in view_projection]
    return tuple(p[0] * m[4 * r] + p[1] * m[4 * r + 1] + p[2] * m[4 * r + 2] + m[4 * r + 3] for r in range(4))


def in_clip(c: Sequence[Column]) -> Column:
    """in front, and within the unit cube after the division."""
    w = F.when(c[3] > 1e-6, c[3])
    return F.coalesce((F.abs(c[0] / w) <= 1) & (F.abs(c[1] / w) <= 1) & (F.abs(c[2] / w) <= 1), F.lit(False))


def to_pixel(c: Sequence[Column], width: int, height: int) -> tuple[Column, Column]:
    """Pixel coordinates; null behind the eye."""
    w = F.when(c[3] > 1e-6, c[3])
    return (c[0] / w * 0.5 + 0.5) * width, (c[1] / w * 0.5 + 0.5) * height


def world_to_pixels(diameter: Number, p11: float, height: int, depth: Column) -> Column:
    """Pixels across of a world diameter at a depth."""
    return col(diameter) * abs(p11) * height / (2.0 * F.greatest(depth, F.lit(0.001)))


def plane_distance(p: Vec, plane: Sequence[float]) -> Column:
    return dot(p, plane[:3]) + float(plane[3])


def support_confidence(normal: Vec, neighbours: Column) -> Column:
    """Raised by a valid normal, lowered by a zero one, scaled by the field of neighbours."""
    has = dot(normal, normal) > 1e-12
    return clamp((0.72 + F.when(has, 0.18).otherwise(-0.22)) * (0.35 + 0.65 * clamp(neighbours)))


def flow_direction(normal: Vec) -> Vec:
    """Gravity (0, 0, -1) along the surface of a unit normal; gravity itself where the surface is level."""
    n = normal
    along = (n[2] * n[0], n[2] * n[1], n[2] * n[2] - 1.0)
    return normalise(along, 1e-10, (0.0, 0.0, -1.0))


def lateral(normal: Vec, tangent: Vec) -> Vec:
    """Across the tangent and along the surface of a unit normal; x where that is undefined."""
    return normalise(cross(normal, tangent), 1e-12, (1.0, 0.0, 0.0))


def staged(df: DataFrame, **vectors: Vec) -> DataFrame:
    """df with vectors as columns name_x, name_y, name_z.

    What later steps use more than once is worked out once: without the step, each use would repeat the whole expression.
    """
    return df.withColumns({f"{name}_{a}": c for name, v in vectors.items() for a, c in zip("xyz", v)})


def at(name: str) -> Vec:
    """The columns of a staged vector."""
    return vec(f"{name}_x", f"{name}_y", f"{name}_z")


def unstaged(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[f"{n}_{a}" for n in names for a in "xyz"])


def downhill_score(drop: Column, distance: Column, align: Column, confidence: Column, coherence: Column, bridge: Column, uphill: Column, flatness: Column, branching: Number) -> Column:
    """The worth of a step between support points."""
    return 3.2 * drop / F.greatest(distance, F.lit(0.02)) + 1.9 * align + 1.6 * confidence + 0.55 * coherence - bridge - uphill + 0.22 * flatness * col(branching)


# Compositing.


def falloff(r: Column, profile: str) -> Column:
    """Alpha at a distance from a point's centre, 1 at its edge."""
    return {
        "hard": F.when(r <= 1, 1.0).otherwise(0.0),
        "soft": 1.0 - smoothstep_any(0.0, 1.0, r),
        "gaussian": F.when(r <= 1, F.exp(-4.0 * r * r)).otherwise(0.0),
        "rim": F.when(r <= 1, smoothstep_any(0.55, 1.0, r)).otherwise(0.0),
    }[profile]


def oit_weight(alpha: Column, depth: Column) -> Column:
    """Weight of a fragment by opacity and depth 0..1."""
    o = F.least(F.lit(1.0), 8.0 * alpha) + 0.01
    o3 = o * o * o
    return clamp(0.5 * o3 + 128.0 * o3 * F.pow(1.0 - depth, F.lit(4.0)), 1e-3, 256.0)


def xray_alpha(depth: Column, scene: Column, front: Number, hidden: Number, decay: Number) -> Column:
    """Alpha before, and decaying behind, what stands at ``scene`` depth; null is open space."""
    behind = F.greatest(depth - scene, F.lit(0.0))
    return F.when(scene.isNull() | (depth <= scene), col(front)).otherwise(col(hidden) * F.exp(-behind * col(decay)))


def alpha_writes_depth(mode: str, alpha: Column, threshold: Number) -> Column:
    """F17."""
    return {"none": F.lit(False), "threshold": alpha >= col(threshold), "always": F.lit(True)}[mode]


def depth_compatible(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """within the greater of both tolerances; unknown depths are."""
    close = F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(close, F.lit(True))


def linear_to_srgb(x: Column) -> Column:
    """E18."""
    x = clamp(x)
    return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def to_byte(x: Column) -> Column:
    """0..255, halves away from zero; 0 for what is not finite."""
    return F.when(is_finite(x), F.floor(clamp(x) * 255.0 + 0.5)).otherwise(0).cast("int")


# Frames and lenses (E35, E38, E39, E44, SRC25).

TIMEBASE = 30


def rescale_frames(frames: Column, fps: int) -> Column:
    """Frames at 30 per second to another rate, one at least."""
    return F.greatest(F.floor((frames * fps + TIMEBASE // 2) / TIMEBASE).cast("long"), F.lit(1))


def point_size_scale(width: Column, height: Column, w0: int = 1920, h0: int = 1080) -> Column:
    """By the geometric mean of the ratios; 1 for an empty picture."""
    empty = (width <= 0) | (height <= 0)
    return F.when(empty, 1.0).otherwise(F.greatest(F.sqrt(width / float(w0) * height / float(h0)), F.lit(0.001)))


def frames_for_speed(distance: Column, speed: Number, keys: Column) -> Column:
    """Frames that a path takes at a speed, one for each segment at least."""
    return F.greatest(F.ceil(distance / F.greatest(col(speed), F.lit(1e-6)) * TIMEBASE).cast("long"), keys.cast("long") - 1)


APERTURE = 41.4214


def focal_from_fov(fov_degrees: Column, aspect: Number) -> Column:
    """Focal length of a vertical field of view under the horizontal aperture."""
    return APERTURE / col(aspect) / (2.0 * F.tan(F.radians(fov_degrees) / 2.0))


def fov_from_focal(focal: Column, aspect: Number) -> Column:
    return F.degrees(2.0 * F.atan(APERTURE / col(aspect) / (2.0 * focal)))


def frame_path(frame: Column) -> Column:
    """SRC25."""
    return F.format_string("frame_%06d.exr", (frame + 1).cast("long"))


# Names (E40-E42, ST1).


def stem(name: Column) -> Column:
    """Runs of what is no ASCII letter or digit become one underscore, none at the end."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "_+$", "")


def field_key(name: Column) -> Column:
    """E42."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def display_name(name: Column) -> Column:
    """SRC3, ST1: without the scalar_ prefix and line ends."""
    return F.regexp_replace(F.regexp_replace(name, "^scalar_", ""), "[\\r\\n]+$", "")


def visual_name(name: Column, default: str = "Visual") -> Column:
    """Trimmed; a trailing run of edited marks becomes one; the default if nothing is left."""
    trimmed = F.regexp_replace(F.trim(name), r"(?i)(\s*[\(\[]edited[\)\]])+$", " (edited)")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(default)).otherwise(trimmed)
