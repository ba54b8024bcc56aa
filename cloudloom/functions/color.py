"""Colours: colormaps, HSL, tints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudloom.functions.scalar import Number, clamp, col, lerp

Rgb = tuple[Column, Column, Column]

# Each fifteenth of the 256 published colours of the perceptual maps, from the first to the last.
KNOTS: dict[str, str] = {
    "viridis": "440154 481769 472A7A 433D84 3D4E8A 355E8D 2E6D8E 297B8E 23898E 1F978B 21A585 2EB37C 46C06F 65CB5E 89D548 B0DD2F D8E219 FDE725",
    "plasma": "0D0887 2F0596 4903A0 6100A7 7801A8 8E0CA4 A21D9A B42E8D C43E7F D24F71 DE6164 E97257 F3854B F99A3E FDAF31 FDC627 F8DF25 F0F921",
    "inferno": "000004 0A0722 1E0C45 380962 510E6C 69166E 801F6C 982766 B0315B C63D4D D94D3D E9612B F47918 FA9407 FCB014 F8CD37 F2EA69 FCFFA4",
    "magma": "000004 090720 1A1042 311165 4A1079 621980 792282 912B81 AA337D C23B75 D9466B EC5860 F7725C FC8E64 FEAA74 FEC68A FDE2A3 FCFDBF",
    "cividis": "00224E 002D68 163770 2E416D 3F4C6C 4E566C 5C616E 696B71 767676 838179 928C78 A09875 AFA471 BFB06B CFBD62 DFCA57 F0D846 FEE838",
    "turbo": "30123B 3F3E9C 4666DD 458CFD 2FB2F4 1AD4D0 22EBAA 52FA7A 8BFF4B B7F735 DBE236 F5C53A FEA130 F9751D E84B0C CE2D04 A91601 7A0403",
}

# Stops (position, red, green, blue) of the piecewise linear colormaps.
STOPS: dict[str, tuple[tuple[float, float, float, float], ...]] = {
    "topographic": ((0.0, 0.03, 0.12, 0.28), (0.16, 0.10, 0.36, 0.58), (0.28, 0.50, 0.76, 0.69), (0.34, 0.78, 0.70, 0.45), (0.48, 0.28, 0.55, 0.24), (0.64, 0.58, 0.50, 0.30), (0.80, 0.50, 0.42, 0.38), (1.0, 0.96, 0.95, 0.90)),
    "land_surface": ((0.0, 0.10, 0.13, 0.06), (0.18, 0.23, 0.31, 0.12), (0.38, 0.38, 0.52, 0.20), (0.58, 0.65, 0.58, 0.32), (0.76, 0.72, 0.45, 0.25), (0.90, 0.55, 0.50, 0.45), (1.0, 0.86, 0.82, 0.72)),
    "exponential_fire": ((0.0, 0.0, 0.0, 0.0), (0.30, 0.25, 0.0, 0.06), (0.55, 0.85, 0.10, 0.02), (0.76, 1.0, 0.48, 0.0), (0.92, 1.0, 0.92, 0.20), (1.0, 1.0, 1.0, 0.92)),
    "exponential_ice": ((0.0, 0.0, 0.02, 0.08), (0.35, 0.02, 0.14, 0.36), (0.60, 0.04, 0.48, 0.78), (0.82, 0.38, 0.86, 0.95), (1.0, 0.96, 1.0, 1.0)),
    "high_contrast": ((0.0, 0.0, 0.0, 0.0), (0.12, 0.10, 0.0, 0.32), (0.32, 0.0, 0.12, 0.85), (0.50, 0.0, 0.82, 0.95), (0.68, 0.98, 0.92, 0.0), (0.84, 1.0, 0.26, 0.0), (1.0, 1.0, 1.0, 1.0)),
}
#: The stop maps that are read along an exponential curve.
EXPONENTS = {"exponential_fire": 3.0, "exponential_ice": 2.7}
COLORMAPS = (*KNOTS, *STOPS, "custom_gradient")
SAMPLES = 256


def knots(name: str) -> list[tuple[int, int, int]]:
    return [tuple(bytes.fromhex(k)) for k in KNOTS[name].split()]


def table(name: str, degree: int = 5) -> list[tuple[float, float, float]]:
    """256 colours of a perceptual map in 0..255: the published ones at the knots, and between them the polynomial through the knots around."""
    known, out = knots(name), []
    step = (SAMPLES - 1) / (len(known) - 1)
    for i in range(SAMPLES):
        first = min(max(int(i / step) - degree // 2, 0), len(known) - 1 - degree)
        at = range(first, first + degree + 1)
        weights = []
        for j in at:
            w = 1.0
            for m in at:
                w *= 1.0 if m == j else (i / step - m) / (j - m)
            weights.append(w)
        out.append(tuple(min(255.0, max(0.0, sum(w * known[j][c] for w, j in zip(weights, at)))) for c in range(3)))
    return out


def from_table(rgb: Sequence[tuple[int, int, int]], x: Column) -> Rgb:
    """Neighbouring entries blended."""
    at = clamp(x) * (len(rgb) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.lit(len(rgb) - 1))
    out = []
    for c in range(3):
        levels = F.array(*[F.lit(v[c] / 255.0) for v in rgb])
        out.append(lerp(levels[low], levels[high], at - low))
    return tuple(out)


def exponential(x: Column, k: float) -> Column:
    """(e^(k x) - 1) / (e^k - 1)."""
    import math

    return (F.exp(k * clamp(x)) - 1.0) / (math.exp(k) - 1.0)


def from_stops(stops: Sequence[Sequence[float]], x: Column) -> Rgb:
    """Linear between the stops."""
    x = clamp(x)
    out = []
    for c in range(1, 4):
        value = F.lit(stops[-1][c])
        for a, b in reversed(list(zip(stops, stops[1:]))):
            value = F.when(x <= b[0], lerp(a[c], b[c], (x - a[0]) / max(b[0] - a[0], 1e-6))).otherwise(value)
        out.append(value)
    return tuple(out)


def gradient(start: Sequence[float], end: Sequence[float], x: Column) -> Rgb:
    """E13."""
    return tuple(lerp(a, b, clamp(x)) for a, b in zip(start, end))


def colormap(name: str, x: Column) -> Rgb:
    """The colour at x in 0..1; an unknown name is viridis."""
    if name == "custom_gradient":
        return gradient((0, 0, 0), (1, 1, 1), x)
    if name in STOPS:
        return from_stops(STOPS[name], exponential(x, EXPONENTS[name]) if name in EXPONENTS else x)
    return from_table(table(name if name in KNOTS else "viridis"), x)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """Colour bytes, clamped and truncated, as R, G, B, 255 from the low byte."""
    r, g, b = (F.floor(clamp(x, 0, 255)).cast("long") for x in (r, g, b))
    return r + g * 256 + b * 65536 + F.lit(255 << 24)


def unpack_rgb(packed: Column) -> Rgb:
    """Red is the low byte."""
    return tuple(F.shiftright(packed, 8 * i).bitwiseAND(F.lit(255)) / 255.0 for i in range(3))


def rgb_to_hsl(rgb: Rgb) -> Rgb:
    """Hue, saturation and lightness in 0..1."""
    r, g, b = rgb
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span, light = hi - lo, (hi + lo) / 2.0
    grey = span <= 1e-5
    safe = F.when(grey, 1.0).otherwise(span)
    sat = F.when(grey, 0.0).otherwise(span / F.greatest(1.0 - F.abs(2.0 * light - 1.0), F.lit(1e-5)))
    sector = F.when(hi == r, F.pmod((g - b) / safe, F.lit(6.0))).when(hi == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0)
    return F.when(grey, 0.0).otherwise(sector / 6.0), clamp(sat), light


def hsl_to_rgb(hsl: Rgb) -> Rgb:
    h, s, light = hsl
    chroma = (1.0 - F.abs(2.0 * light - 1.0)) * s
    out = []
    for shift in (0.0, 4.0, 2.0):  # a channel is a trapezoid of the hue
        k = F.pmod(h * 6.0 + shift, F.lit(6.0))
        ramp = clamp(F.abs(k - 3.0) - 1.0)
        out.append(light + chroma * (ramp - 0.5))
    return tuple(out)


def mix(a: Rgb, b: Rgb, t: Number) -> Rgb:
    return tuple(lerp(x, y, t) for x, y in zip(a, b))


def colourise(source: Rgb, tint: Rgb, amount: Number) -> Rgb:
    """The tint's hue and saturation with the source's lightness."""
    hue, sat, _ = rgb_to_hsl(tint)
    return mix(source, hsl_to_rgb((hue, sat, rgb_to_hsl(source)[2])), amount)


def point_colour(mode: str, *, source: Rgb | None, solid: Sequence[float], position: Column, map_name: str, tint: Sequence[float] | None = None, amount: Number = 0.0, effect: Rgb | None = None, effect_mix: Number = 0.0) -> Rgb:
    """Source colour, else the colormap, else solid; then colourised; then tinted by effects."""
    if mode == "source" and source is not None:
        rgb = source
    elif mode == "colormap":
        rgb = colormap(map_name, position)
    else:
        rgb = tuple(F.lit(float(c)) for c in solid)
    if tint is not None:
        rgb = colourise(rgb, tuple(F.lit(float(c)) for c in tint), amount)
    return rgb if effect is None else mix(rgb, effect, clamp(col(effect_mix)))


# The blues that particles are picked from.
PARTICLES = ((0.05, 0.20, 0.45), (0.08, 0.32, 0.60), (0.12, 0.45, 0.74), (0.25, 0.60, 0.85), (0.48, 0.76, 0.93), (0.78, 0.92, 0.99))


def particle_colour(seed: Column) -> Rgb:
    """One of six blues by hash."""
    from cloudloom.functions.scalar import hash_unit

    at = F.least((hash_unit(seed) * len(PARTICLES)).cast("int"), F.lit(len(PARTICLES) - 1))
    return tuple(F.array(*[F.lit(p[c]) for p in PARTICLES])[at] for c in range(3))
