"""Camera arithmetic of the driver: a few numbers a view."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class Camera:
    """Where a view stands and looks; z is up, an orientation (x, y, z, w) overrides the target."""

    position: tuple[float, float, float] = (0.0, -5.0, 2.0)
    target: tuple[float, float, float] = (0.0, 0.0, 0.0)
    fov: float = 50.0
    near: float = 0.01
    far: float = 1000.0
    orientation: tuple[float, float, float, float] | None = None


def _unit(v):
    n = np.linalg.norm(v)
    return v / n if n > 1e-12 else np.array([0.0, 0.0, -1.0])


def axes(c: Camera) -> np.ndarray:
    """Right, up and back of a camera that looks down its own -z."""
    if c.orientation is not None:
        x, y, z, w = np.array(c.orientation) / np.linalg.norm(c.orientation)
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        return r.T
    ahead = _unit(np.array(c.target, float) - np.array(c.position, float))
    up = np.array([0.0, 1.0, 0.0]) if abs(ahead[2]) > 0.995 else np.array([0.0, 0.0, 1.0])
    right = _unit(np.cross(ahead, up))
    return np.stack([right, np.cross(right, ahead), -ahead])


def look_at_quaternion(c: Camera) -> tuple[float, float, float, float]:
    """The orientation (x, y, z, w) that looks at the target."""
    m = axes(replace(c, orientation=None)).T
    w = math.sqrt(max(0.0, 1 + m[0, 0] + m[1, 1] + m[2, 2])) / 2
    x = math.copysign(math.sqrt(max(0.0, 1 + m[0, 0] - m[1, 1] - m[2, 2])) / 2, m[2, 1] - m[1, 2])
    y = math.copysign(math.sqrt(max(0.0, 1 - m[0, 0] + m[1, 1] - m[2, 2])) / 2, m[0, 2] - m[2, 0])
    z = math.copysign(math.sqrt(max(0.0, 1 - m[0, 0] - m[1, 1] + m[2, 2])) / 2, m[1, 0] - m[0, 1])
    return x, y, z, w


def view(c: Camera) -> np.ndarray:
    """E45."""
    out = np.eye(4)
    out[:3, :3] = axes(c)
    out[:3, 3] = -out[:3, :3] @ np.array(c.position, float)
    return out


def projection(c: Camera, aspect: float) -> np.ndarray:
    """Perspective with depth 0..1 and y down."""
    f = 1 / math.tan(math.radians(c.fov) / 2)
    out = np.zeros((4, 4))
    out[0, 0], out[1, 1] = f / aspect, -f
    out[2, 2], out[2, 3] = c.far / (c.near - c.far), c.near * c.far / (c.near - c.far)
    out[3, 2] = -1
    return out


def view_projection(c: Camera, width: int, height: int) -> list[float]:
    return (projection(c, width / height) @ view(c)).ravel().tolist()


def orthographic(cx: float, cy: float, half: float, depth: float = 100.0) -> list[float]:
    """A view straight down on a square."""
    return [1 / half, 0, 0, -cx / half, 0, 1 / half, 0, -cy / half, 0, 0, 1 / depth, 0, 0, 0, 0, 1]


def orbit(c: Camera, yaw: float, pitch: float) -> Camera:
    """Around the target, by degrees."""
    d = np.array(c.position, float) - np.array(c.target, float)
    r = np.linalg.norm(d)
    a, e = math.atan2(d[1], d[0]) + math.radians(yaw), math.asin(max(-1.0, min(1.0, d[2] / max(r, 1e-9)))) + math.radians(pitch)
    e = max(-1.55, min(1.55, e))
    at = np.array(c.target) + r * np.array([math.cos(e) * math.cos(a), math.cos(e) * math.sin(a), math.sin(e)])
    return replace(c, position=tuple(at.tolist()))


def pan(c: Camera, dx: float, dy: float) -> Camera:
    """Sideways with the target."""
    right, up, _ = axes(c)
    step = right * dx + up * dy
    return replace(c, position=tuple((np.array(c.position) + step).tolist()), target=tuple((np.array(c.target) + step).tolist()))


def dolly(c: Camera, delta: float) -> Camera:
    """Towards the target by e^(-0.075 delta), delta within 8 either way."""
    k = math.exp(-0.075 * max(-8.0, min(8.0, delta)))
    at = np.array(c.target) + (np.array(c.position) - np.array(c.target)) * k
    return replace(c, position=tuple(at.tolist()))


def frame(c: Camera, low: Sequence[float], high: Sequence[float]) -> Camera:
    """So that a box fills the view, at 1.35 times the distance it needs."""
    centre = (np.array(low) + np.array(high)) / 2
    radius = np.linalg.norm(np.array(high) - np.array(low)) / 2
    away = -_unit(np.array(c.target, float) - np.array(c.position, float))
    distance = 1.35 * max(radius, 1e-3) / math.sin(math.radians(c.fov) / 2)
    return replace(c, position=tuple((centre + away * distance).tolist()), target=tuple(centre.tolist()))
