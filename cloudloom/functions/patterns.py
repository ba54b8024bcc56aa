"""Procedural patterns in Arrow batches (E52-E65, E80-E82, E86, E87): vectorised numpy, the same for pandas UDFs and tests.

A pattern is a function of a place (u, v) in metres, a time and a seed, with values in 0..1.  The exact noise of a pattern is its own; what is fixed is its
kind: cells with ridges, rings, bands, trails, veins, glints, threads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("caustic_lace", "linear", "radial", "rain_rings", "tide_bands", "wet_sheen", "current_threads", "droplet_glints", "drip_trails", "foam_sparkle", "mineral_shimmer")


@dataclass(frozen=True)
class Pattern:
    """Settings of a pattern: scale (metres), wavelength, speed, warp, turbulence, density and direction."""

    kind: str = "linear"
    scale: float = 0.25
    wavelength: float = 0.16
    speed: float = 0.35
    warp: float = 0.25
    turbulence: float = 0.25
    density: float = 0.5
    direction: tuple[float, float] = (1.0, 0.0)
    phase: float = 0.0


#: What a pattern of each type starts with.
DEFAULTS = {
    "caustic_lace": Pattern("caustic_lace", 0.30, 0.16, 0.25, 0.45, 0.35, 0.6),
    "linear": Pattern("linear", 0.25, 0.16, 0.35, 0.20, 0.20, 0.5),
    "radial": Pattern("radial", 0.25, 0.18, 0.30, 0.20, 0.20, 0.5),
    "rain_rings": Pattern("rain_rings", 0.35, 0.10, 0.50, 0.05, 0.10, 0.5),
    "tide_bands": Pattern("tide_bands", 0.80, 0.60, 0.12, 0.50, 0.35, 0.5),
    "wet_sheen": Pattern("wet_sheen", 0.40, 0.20, 0.08, 0.30, 0.25, 0.5),
    "current_threads": Pattern("current_threads", 0.20, 0.30, 0.45, 0.45, 0.40, 0.6),
    "droplet_glints": Pattern("droplet_glints", 0.12, 0.05, 0.60, 0.00, 0.10, 0.4),
    "drip_trails": Pattern("drip_trails", 0.22, 0.40, 0.18, 0.20, 0.20, 0.4),
    "foam_sparkle": Pattern("foam_sparkle", 0.14, 0.08, 0.40, 0.25, 0.35, 0.7),
    "mineral_shimmer": Pattern("mineral_shimmer", 0.28, 0.12, 0.10, 0.35, 0.30, 0.5),
}
#: The fields of Pattern that each type's controls set.
CONTROLS = {k: ("scale", "wavelength", "speed", "warp", "turbulence", "density", "direction") if k in ("linear", "tide_bands", "current_threads", "drip_trails") else ("scale", "wavelength", "speed", "warp", "turbulence", "density") for k in TYPES}


def _hash(*keys: np.ndarray | int) -> np.ndarray:
    """A number in 0..1 for whole-number keys."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for k in keys:
        h = (np.asarray(k).astype(np.int64).view(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(40)).astype(float) / float((1 << 24) - 1)


def _fade(t):
    t = np.clip(t, 0, 1)
    return t * t * (3 - 2 * t)


def _noise(u, v, seed):
    """Lattice values blended by a cubic fade."""
    i, j = np.floor(u), np.floor(v)
    a, b = _fade(u - i), _fade(v - j)
    at = lambda di, dj: _hash(i + di, j + dj, seed)
    low = at(0, 0) + (at(1, 0) - at(0, 0)) * a
    high = at(0, 1) + (at(1, 1) - at(0, 1)) * a
    return low + (high - low) * b


def _octaves(u, v, seed, n=3):
    return sum(_noise(u * 2**k, v * 2**k, seed + k) / 2**k for k in range(n)) / sum(1 / 2**k for k in range(n))


def _warped(u, v, p, t, seed):
    k = p.warp * p.scale
    return u + k * (_noise(u / p.scale, v / p.scale + 0.3 * t, seed + 11) - 0.5), v + k * (_noise(u / p.scale + 0.3 * t, v / p.scale, seed + 12) - 0.5)


def _cells(u, v, seed, reach=1, t=None):
    """Distances to the feature points of the cells around, nearest first, with a number for each cell: shapes (k, n)."""
    i, j = np.floor(u), np.floor(v)
    distance, label = [], []
    for di in range(-reach, reach + 1):
        for dj in range(-reach, reach + 1):
            x, y = _hash(i + di, j + dj, seed), _hash(i + di, j + dj, seed + 1)
            if t is not None:
                x, y = 0.5 + 0.4 * np.sin(6.2832 * x + t), 0.5 + 0.4 * np.sin(6.2832 * y + 1.3 * t)
            distance.append(np.hypot(i + di + x - u, j + dj + y - v))
            label.append(_hash(i + di, j + dj, seed + 2))
    distance, label = np.array(distance), np.array(label)
    order = np.argsort(distance, axis=0)
    return np.take_along_axis(distance, order, 0), np.take_along_axis(label, order, 0)


def _ridge(u, v, seed, t, width=0.12):
    d, _ = _cells(u, v, seed, t=t)
    return 1 - _fade((d[1] - d[0]) / width)


def caustic_lace(u, v, t, p, seed):
    """Ridges between moving cells, warped."""
    u, v = _warped(u, v, p, t, seed)
    s = p.scale * 0.6
    return _ridge(u / s, v / s, seed, p.speed * t * 2)


def linear(u, v, t, p, seed):
    """Crests across the direction."""
    along = u * p.direction[0] + v * p.direction[1]
    wobble = p.warp * p.wavelength * (_noise(u / p.scale, v / p.scale, seed) - 0.5)
    return (0.5 + 0.5 * np.cos(6.283185307179586 * ((along + wobble) / p.wavelength - p.phase - t * p.speed))) ** 4


def radial(u, v, t, p, seed):
    """Rings around the origin."""
    return (0.5 + 0.5 * np.cos(6.283185307179586 * (np.hypot(u, v) / p.wavelength - p.phase - t * p.speed))) ** 6


def rain_rings(u, v, t, p, seed):
    """Drops in 5 x 5 cells, each with a ring that grows and fades in its own time."""
    u, v = u / p.scale, v / p.scale
    i, j = np.floor(u), np.floor(v)
    out = np.zeros_like(u)
    for di in range(-2, 3):
        for dj in range(-2, 3):
            on = _hash(i + di, j + dj, seed + 3) < p.density
            age = (t * p.speed + _hash(i + di, j + dj, seed + 4)) % 1.0
            r = np.hypot(i + di + _hash(i + di, j + dj, seed) - u, j + dj + _hash(i + di, j + dj, seed + 1) - v)
            out = np.maximum(out, on * (1 - age) * (1 - _fade(np.abs(r - age * 1.8) / 0.14)))
    return out


def tide_bands(u, v, t, p, seed):
    """A front that swings along the direction, with foam behind it."""
    along = u * p.direction[0] + v * p.direction[1]
    front = p.wavelength * (0.5 + 0.5 * np.sin(6.283185307179586 * (t * p.speed + p.phase))) + p.warp * p.scale * (_octaves(u / p.scale, v / p.scale, seed) - 0.5)
    behind = front - along
    edge = 1 - _fade(np.abs(behind) / (0.12 * p.wavelength))
    foam = (behind > 0) * np.exp(-np.maximum(behind, 0) / p.wavelength) * _octaves(u / (0.2 * p.scale), v / (0.2 * p.scale), seed + 5)
    return np.clip(edge + 0.6 * p.density * foam, 0, 1)


def wet_sheen(u, v, t, p, seed):
    """Slow soft patches."""
    n = _octaves(u / p.scale + 0.2 * t * p.speed, v / p.scale, seed)
    return _fade((n - (0.65 - 0.35 * p.density)) / 0.3)


def current_threads(u, v, t, p, seed):
    """Bent threads along the direction with pulses that travel on them."""
    a, b = u * p.direction[0] + v * p.direction[1], -u * p.direction[1] + v * p.direction[0]
    row = np.floor(b / p.scale)
    out = np.zeros_like(u)
    for d in (-1, 0, 1):
        own = _hash(row + d, seed)
        bend = p.warp * p.scale * (_noise(a / (2 * p.scale), row + d, seed + 6) - 0.5)
        off = b - (row + d + own) * p.scale - bend
        pulse = 0.5 + 0.5 * np.cos(6.283185307179586 * (a / p.wavelength - t * p.speed + own))
        out = np.maximum(out, (own < 0.4 + 0.6 * p.density) * (1 - _fade(np.abs(off) / (0.18 * p.scale))) * pulse)
    return out


def droplet_glints(u, v, t, p, seed):
    """Clusters of points that twinkle."""
    d, label = _cells(u / p.scale, v / p.scale, seed)
    twinkle = (0.5 + 0.5 * np.sin(6.283185307179586 * (t * p.speed + label[0]))) ** 4
    return (label[0] < p.density) * (1 - _fade(d[0] / 0.22)) * twinkle


def drip_trails(u, v, t, p, seed):
    """Drops that run along the direction and leave a tapering trail."""
    a, b = u * p.direction[0] + v * p.direction[1], -u * p.direction[1] + v * p.direction[0]
    lane = np.floor(b / p.scale)
    out = np.zeros_like(u)
    for d in (-1, 0, 1):
        own, start = _hash(lane + d, seed), _hash(lane + d, seed + 7)
        behind = ((t * p.speed + start) - a / p.wavelength) % 1.0
        width = 0.16 * p.scale * (1 - behind)
        off = np.abs(b - (lane + d + own) * p.scale)
        out = np.maximum(out, (own < 0.3 + 0.7 * p.density) * (1 - behind) * (1 - _fade(off / np.maximum(width, 1e-6))))
    return out


def foam_sparkle(u, v, t, p, seed):
    """Ridges among the three nearest points of cells that change in time, with flecks."""
    d, label = _cells(u / p.scale, v / p.scale, seed, t=p.speed * t * 2)
    ridge = 1 - _fade((d[1] - d[0]) / 0.16)
    corner = 1 - _fade((d[2] - d[0]) / 0.3)
    fleck = (_hash(np.floor(u / (0.15 * p.scale)), np.floor(v / (0.15 * p.scale)), seed + 8) > 1 - 0.25 * p.density) * (0.5 + 0.5 * np.sin(6.283185307179586 * (t * p.speed + label[0])))
    return np.clip(0.7 * ridge + 0.3 * corner + 0.5 * fleck * ridge, 0, 1)


def mineral_shimmer(u, v, t, p, seed):
    """Two nets of veins that shimmer against each other."""
    u, v = _warped(u, v, p, 0.2 * t, seed)
    one = _ridge(u / p.scale, v / p.scale, seed, None)
    two = _ridge(u / (0.45 * p.scale), v / (0.45 * p.scale), seed + 9, None)
    return np.clip(one * 0.7 + two * 0.45 * (0.5 + 0.5 * np.sin(6.283185307179586 * (t * p.speed + _noise(u / p.scale, v / p.scale, seed + 10)))), 0, 1)


#: E56.
FUNCTIONS: dict[str, Callable] = {k: globals()[k] for k in TYPES}


def evaluate(p: Pattern, u: np.ndarray, v: np.ndarray, t: float, seed: int = 0) -> np.ndarray:
    """The pattern's value, 0..1; an unknown kind is linear."""
    with np.errstate(over="ignore"):
        return np.clip(np.nan_to_num(FUNCTIONS.get(p.kind, linear)(np.asarray(u, float), np.asarray(v, float), float(t), p, seed)), 0, 1)


def pattern_column(p: Pattern, u: Column, v: Column, t: float, seed: int = 0) -> Column:
    """E56 as a column, in Arrow batches."""

    @F.pandas_udf("double")
    def value(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(evaluate(p, u.to_numpy(float), v.to_numpy(float), t, seed))

    return value(u, v)


def roughness_offset(u, v, t, amount: float, roughness, seed: int = 0) -> np.ndarray:
    """Three octaves of moving noise about 0, where the surface is rough."""
    return amount * np.clip(roughness, 0, 1) * (2 * _octaves(np.asarray(u, float) + 0.2 * t, np.asarray(v, float), seed) - 1)


def stylise(rgb: np.ndarray, u, v, mode: str, strength: float = 1.0, seed: int = 0) -> np.ndarray:
    """Colours (n, 3) as brush strokes, watercolour, cartoon steps or hatching."""
    rgb, u, v = np.asarray(rgb, float), np.asarray(u, float), np.asarray(v, float)
    if mode == "cartoon":
        new = np.round(rgb * 4) / 4
    elif mode == "watercolour":
        new = rgb * (0.8 + 0.4 * _octaves(u, v, seed))[:, None]
    elif mode == "brush":
        new = rgb * (0.85 + 0.3 * _noise(u * 6, v, seed))[:, None]
    elif mode == "hatch":
        new = rgb * (0.6 + 0.4 * (np.sin(40 * (u + v)) > 2 * rgb.mean(1) - 1))[:, None]
    else:
        new = rgb
    return np.clip(rgb + (new - rgb) * strength, 0, 1)


def caustic_strength(u, v, t, cell: float, line: float, edge, seed: int = 0) -> np.ndarray:
    """Brightness of a Voronoi ridge of a given width, gated by the distance to the region's edge."""
    with np.errstate(over="ignore"):
        d, _ = _cells(np.asarray(u, float) / cell, np.asarray(v, float) / cell, seed, t=t)
    return (1 - _fade((d[1] - d[0]) / max(1e-6, line / cell))) * _fade(np.asarray(edge, float) / max(1e-6, 0.25 * cell))


def lane_offset(phase, seed, lanes: int, span: float, crossing: float, segments: int = 12) -> np.ndarray:
    """Sideways place of a stream on its route: hashed lanes held over segments, blended where they change."""
    phase = np.asarray(phase, float) % 1.0
    n = max(1, min(12, segments))
    at = phase * n
    i = np.floor(at)
    lane = lambda k: np.floor(_hash(seed, k) * max(1, lanes))
    moves = _hash(seed, i, 5) < crossing
    a, b = lane(i - (i % 2)), np.where(moves, lane(i + 1), lane(i - (i % 2)))
    place = a + (b - a) * _fade(at - i)
    return (place + 0.5) / max(1, lanes) * span - span / 2


def catmull_rom(p0, p1, p2, p3, t):
    """The curve through p1 and p2."""
    return 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t**3)
