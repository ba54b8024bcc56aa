"""OpenEXR pictures without compression (SRC21, SRC22): half colour and alpha, float depth, optional normal and albedo."""

from __future__ import annotations

import struct

import numpy as np


def _attribute(name: str, kind: str, data: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(data)) + data


def encode(width: int, height: int, rgb: np.ndarray, alpha: np.ndarray, depth: np.ndarray, *, normal: np.ndarray | None = None, albedo: np.ndarray | None = None) -> bytes:
    """The file: rgb (h, w, 3), alpha and depth (h, w).  Negatives and depths that are not finite become 0; a wrong size is an error."""
    planes: dict[str, tuple[str, np.ndarray]] = {"A": ("half", np.clip(alpha, 0, 1)), "Z": ("float", np.where(np.isfinite(depth), depth, 0))}
    planes |= {c: ("half", np.maximum(rgb[..., i], 0)) for i, c in enumerate("RGB")}
    if normal is not None:
        planes |= {f"N.{c}": ("half", normal[..., i]) for i, c in enumerate("XYZ")}
    if albedo is not None:
        planes |= {f"albedo.{c}": ("half", np.maximum(albedo[..., i], 0)) for i, c in enumerate("RGB")}
    for name, (_, p) in planes.items():
        if p.shape != (height, width):
            raise ValueError(f"channel {name} is {p.shape}, the picture {height, width}")
    names = sorted(planes)
    channels = b"".join(n.encode() + b"\0" + struct.pack("<iB3xii", 1 if planes[n][0] == "half" else 2, 0, 1, 1) for n in names) + b"\0"
    window = struct.pack("<4i", 0, 0, width - 1, height - 1)
    head = struct.pack("<ii", 20000630, 2)
    head += _attribute("channels", "chlist", channels) + _attribute("compression", "compression", b"\0") + _attribute("dataWindow", "box2i", window) + _attribute("displayWindow", "box2i", window)
    head += _attribute("lineOrder", "lineOrder", b"\0") + _attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + _attribute("screenWindowCenter", "v2f", struct.pack("<ff", 0, 0)) + _attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    data = {n: p.astype("<f2" if k == "half" else "<f4") for n, (k, p) in planes.items()}
    lines = [b"".join(data[n][y].tobytes() for n in names) for y in range(height)]
    at, table = len(head) + 8 * height, b""
    for line in lines:
        table += struct.pack("<Q", at)
        at += 8 + len(line)
    return head + table + b"".join(struct.pack("<ii", y, len(line)) + line for y, line in enumerate(lines))


def write_pixels(pixels, path: str, width: int, height: int) -> None:
    """A pixel DataFrame (ix, iy, r, g, b, alpha, depth) as one file; the picture's size bounds what the driver holds."""
    rgb, alpha, depth = np.zeros((height, width, 3)), np.zeros((height, width)), np.full((height, width), np.inf)
    for r in pixels.select("ix", "iy", "r", "g", "b", "alpha", "depth").toLocalIterator():
        rgb[r["iy"], r["ix"]], alpha[r["iy"], r["ix"]], depth[r["iy"], r["ix"]] = (r["r"], r["g"], r["b"]), r["alpha"], r["depth"] if r["depth"] is not None else np.inf
    with open(path, "wb") as f:
        f.write(encode(width, height, rgb, alpha, depth))
