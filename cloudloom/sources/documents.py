"""Versioned JSON documents: projects, water sources, styles, paths (SRC12-SRC17, SRC28, D1j-D7j, D9j-D13j, D16j, D25, D26, E91, E92); caches and jobs are in ``caches``.

Single documents are dictionaries with defaults and migrations, on the driver.  Tables of documents are parsed by ``from_json`` with the same defaults.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECT_VERSION, STYLE_VERSION, SOURCES_VERSION = 24, 2, 6

# Names of enumeration members as documents spell them; the first is the default (D1j).
ENUMS: dict[str, tuple[str, ...]] = {
    "color_mode": ("source_rgb", "solid_color", "scalar_colormap"),
    "colormap": ("viridis", "plasma", "inferno", "magma", "cividis", "turbo", "topographic", "land_surface", "exponential_fire", "exponential_ice", "high_contrast", "custom_gradient"),
    "geometry_mode": ("screen_sprites", "world_surfels", "camera_facing_world_sprites"),
    "sprite_size_mode": ("pixels", "world_millimeters"),
    "depth_contribution": ("none", "alpha_threshold", "always"),
    "falloff": ("hard_disc", "soft_disc", "gaussian", "rim"),
    "stylisation": ("off", "npr_stylisation", "brush_particles"),
    "npr_preset": ("watercolor", "cartoon"),
    "lod_mode": ("full_resolution", "auto_camera_lod", "force_lod"),
    "renderer": ("beauty", "fast_basic"),
    "scale_mode": ("mid", "aerial", "detail"),
    "emitter_origin": ("manual", "auto_suggested", "propagated"),
    "emitter_status": ("candidate", "accepted", "disabled"),
    "assignment": ("default", "custom", "linked_emitter"),
    "feature_type": ("ripple", "field_surface_motion", "field_no_flow_region", "field_bridge_allowed_region", "field_bridge_blocked_region"),
    "ripple_type": ("caustic_lace", "linear_ripples", "radial_ripples", "rain_rings", "shoreline", "wet_sheen", "current_threads", "droplet_glints", "drip_trails", "foam_sparkle", "salt_mineral_shimmer"),
    "blend_mode": ("add", "max", "multiply", "screen", "override"),
    "field_output": ("streamlines", "surface_motion", "both"),
    "trail_motion": ("path", "vector_field"),
    "branch_role": ("main", "secondary", "spread"),
    "termination": ("reached_length", "no_support", "max_steps", "loop", "duplicate", "empty"),
    "binding_mode": ("constant", "field_mapped"),
    "layer_kind": ("point_cloud", "gaussian_splat"),
}
# Older spellings of members and keys.
OLD_MEMBERS = {"ripple_type": {"tide_bands": "shoreline"}, "renderer": {"raytraced": "beauty"}, "npr_preset": {"watercolour": "watercolor"}}
OLD_KEYS = {"stylization": "stylisation", "colorize": "colourise", "colorise": "colourise", "color_mix": "colour_mix"}

BINDING = {"mode": "constant", "constant": [0.0], "slot": -1, "field": "", "input_min": 0.0, "input_max": 1.0, "output_min": 0.0, "output_max": 1.0, "gamma": 1.0, "flags": 5, "active": True}
#: The seven bindings of a style and their constants.
BINDINGS = {"point_size": 1.0, "surfel_diameter": 0.005, "opacity": 1.0, "emissive_strength": 0.0, "xray_strength": 0.0, "depth_fade": 0.0, "colormap_position": 0.5}
STYLE: dict[str, Any] = {
    "color_mode": "source_rgb", "colormap": "viridis", "geometry_mode": "screen_sprites", "sprite_size_mode": "pixels", "depth_contribution": "alpha_threshold", "falloff": "hard_disc",
    "stylisation": "off", "npr_preset": "watercolor", "solid_color": [1.0, 1.0, 1.0], "gradient_start": [0.0, 0.0, 0.0], "gradient_end": [1.0, 1.0, 1.0], "colourise": False, "colourise_color": [1.0, 1.0, 1.0],
    "colourise_amount": 0.0, "alpha_threshold": 0.5, "xray_enabled": False, "xray_hidden_alpha": 0.35, "xray_decay": 4.0, "brush_strength": 0.5, "hatch_strength": 0.0, "motion_amount": 0.0, "caustics_enabled": False,
}
EMITTER: dict[str, Any] = {"id": 0, "name": "", "position": [0.0, 0.0, 0.0], "radius": 0.04, "origin": "manual", "status": "accepted", "assignment": None, "linked_emitter_id": None, "settings": None}
REGION: dict[str, Any] = {"id": 0, "feature_type": "ripple", "vertices": [], "hull": [], "edge_blend_width": 0.05, "direction": [1.0, 0.0, 0.0], "viewport": True, "export": True, "blend_mode": "add", "blend_priority": 0}
RIPPLE: dict[str, Any] = {**REGION, "ripple_type": "caustic_lace", "pattern_settings": {}, "intensity": 1.0, "emission": 1.0, "opacity": 0.0, "size": 0.0, "colour_mix": 0.0}
CAMERA: dict[str, Any] = {"position": [0.0, -5.0, 2.0], "orientation": None, "target": [0.0, 0.0, 0.0], "fov": 50.0, "near": 0.01, "far": 1000.0, "focus_distance": None, "aperture": None}
ANIMATION: dict[str, Any] = {"name": "Path", "duration_frames": 0, "keys": []}
PROJECT: dict[str, Any] = {"name": "Untitled", "renderer": "beauty", "lod_mode": "full_resolution", "point_cap": 10_000_000, "layers": [], "visuals": [], "shots": [], "paths": [], "jobs": [], "emitters": [], "regions": [], "ripple_layers": [], "source_settings": {}, "visual_settings": {}, "trail_settings": {}, "field_settings": {}}
#: Ranges to which settings are clamped on load (D11j).
RANGES = {"trail_count": (1, 20_000), "trail_length": (0.05, 100.0), "trail_width": (0.001, 5.0), "speed": (0.0, 20.0), "looseness": (0.0, 1.0), "turbulence": (0.0, 2.0), "streamline_count": (1, 20_000), "resolution": (0.005, 10.0), "max_bridge": (0.0, 50.0), "cell": (0.001, 100.0), "line": (0.0, 100.0), "feather": (0.0, 100.0), "warp": (0.0, 100.0)}


def enum(kind: str, value: Any) -> str:
    """D1j: the member; the default for what is unknown."""
    value = OLD_MEMBERS.get(kind, {}).get(value, value)
    return value if value in ENUMS[kind] else ENUMS[kind][0]


def enum_column(kind: str, value: Column) -> Column:
    """D1j over a column."""
    for old, new in OLD_MEMBERS.get(kind, {}).items():
        value = F.when(value == old, F.lit(new)).otherwise(value)
    return F.when(value.isin(*ENUMS[kind]), value).otherwise(F.lit(ENUMS[kind][0]))


def with_defaults(value: Mapping | None, defaults: Mapping) -> dict:
    """The defaults with what the document has, enumerations checked; a native key wins over its older spelling."""
    value = dict(value or {})
    for old, new in OLD_KEYS.items():
        if old in value:
            value.setdefault(new, value.pop(old))
    out = {}
    for k, d in defaults.items():
        v = value.get(k, d)
        out[k] = enum(k, v) if k in ENUMS else v if v is not None else d
    return out | {k: v for k, v in value.items() if k not in defaults and k not in OLD_KEYS}


def clamped(settings: Mapping) -> dict:
    """D11j: known numbers within their ranges; what is not finite is left to the default."""
    out = {}
    for k, v in settings.items():
        if k in RANGES and isinstance(v, (int, float)):
            if not math.isfinite(v):
                continue
            lo, hi = RANGES[k]
            v = type(v)(min(hi, max(lo, v)))
        out[k] = v
    return out


def binding(value: Mapping | None, constant: float = 0.0) -> dict:
    """D2j."""
    out = with_defaults(value, BINDING | {"constant": [constant]})
    out["mode"] = enum("binding_mode", out["mode"])
    return out


def style(value: Mapping | None) -> dict:
    """D3j, D4j: a style with its bindings; an old render_mode decides what newer keys do not."""
    value = dict(value or {})
    if "render_mode" in value:
        value = legacy_render_mode(value.pop("render_mode")) | value
    own = value.pop("bindings", {})
    out = with_defaults(value, STYLE)
    out["bindings"] = {k: binding(own.get(k), c) for k, c in BINDINGS.items()}
    return out


def legacy_render_mode(mode: str) -> dict:
    """D4j: what the modes of old styles stand for."""
    solid = {"falloff": "hard_disc", "depth_contribution": "alpha_threshold"}
    return {
        "solid": solid,
        "emissive_hard": {"falloff": "hard_disc", "depth_contribution": "none"},
        "emissive_feathered": {"falloff": "soft_disc", "depth_contribution": "none"},
        "xray": {"xray_enabled": True, "depth_contribution": "none"},
        "gaussian_sprite": {"falloff": "gaussian", "depth_contribution": "none"},
    }.get(mode, solid)


def emitter(value: Mapping) -> dict:
    """D9j: settings without an assignment are custom; a link is kept by a linked one only."""
    out = with_defaults(value, EMITTER)
    given = value.get("assignment")
    out["assignment"] = enum("assignment", given) if given is not None else "custom" if value.get("settings") else "default"
    if out["assignment"] != "linked_emitter":
        out["linked_emitter_id"] = None
    return out


def region(value: Mapping, defaults: Mapping = REGION) -> dict:
    """D9j: with its hull computed where it has none."""
    from cloudloom.operators.regions import hull

    out = with_defaults(value, defaults)
    if not out["hull"] and len(out["vertices"]) >= 3:
        out["hull"] = [list(p) for p in hull([tuple(v) for v in out["vertices"]])]
    return out


def ripple_layer(value: Mapping) -> dict:
    """D10j: each pattern type's defaults, then old active values for the current type, then what is set per type."""
    from dataclasses import asdict

    from cloudloom.functions.patterns import DEFAULTS

    out = region(value, RIPPLE)
    names = {"shoreline": "tide_bands", "linear_ripples": "linear", "radial_ripples": "radial", "salt_mineral_shimmer": "mineral_shimmer"}
    settings = {t: {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(DEFAULTS[names.get(t, t)]).items()} for t in ENUMS["ripple_type"]}
    active = {k: value[k] for k in ("scale", "wavelength", "speed", "warp", "turbulence", "density", "direction") if k in value and k != "direction"}
    settings[out["ripple_type"]] |= active
    for t, own in value.get("pattern_settings", {}).items():
        settings[enum("ripple_type", t)] |= own
    out["pattern_settings"] = settings
    return out


def legacy_looseness(turbulence: float, momentum: float, normal: float) -> float:
    """D11j: .45 c(turbulence / 1.5) + .35 momentum + .20 c(normal / 1.5), c clamping to 0..1."""
    c = lambda x: min(1.0, max(0.0, x))
    return 0.45 * c(turbulence / 1.5) + 0.35 * momentum + 0.20 * c(normal / 1.5)


def legacy_caustic(value: Mapping) -> dict:
    """D11j: cell, line, feather and warp of an old caustic's scale, sharpness and warp."""
    cell = 1 / max(0.01, float(value.get("scale", 1.0)))
    sharp = min(1.0, max(0.0, float(value.get("sharpness", 0.5))))
    line = cell * (0.16 + (0.025 - 0.16) * sharp)
    return {"cell": cell, "line": line, "feather": 0.4 * line, "warp": 0.5 * cell * float(value.get("warp", 0.0))}


def caustics_to_ripples(doc: Mapping) -> list[dict]:
    """D12j: old caustic regions as ripple layers; only where there are no native ones."""
    if doc.get("ripple_layers"):
        return [ripple_layer(r) for r in doc["ripple_layers"]]
    return [ripple_layer({**r, "ripple_type": "caustic_lace", "pattern_settings": {"caustic_lace": {"scale": legacy_caustic(r.get("settings", {}))["cell"]}}}) for r in doc.get("caustic_regions", [])]


def split_bundle(doc: Mapping) -> dict:
    """D13j: an old bundle's bake, render and trail parts as source, visual and trail settings, under what is set anew."""
    old = doc.get("water_settings", {})
    parts = {"source_settings": "bake", "visual_settings": "render", "trail_settings": "bundle"}
    return {new: clamped({**old.get(name, {}), **doc.get(new, {})}) for new, name in parts.items()}


def flow_style(visual: Mapping) -> dict:
    """D16j: a point style for flow overlays out of visual settings: size by width, opacity by confidence."""
    out = style({})
    out["bindings"]["point_size"] = binding({"mode": "field_mapped", "field": "width", "output_min": 1.0, "output_max": float(visual.get("size", 6.0))})
    out["bindings"]["opacity"] = binding({"mode": "field_mapped", "field": "confidence", "output_max": float(visual.get("opacity", 1.0))})
    return out | {"color_mode": "solid_color", "solid_color": list(visual.get("color", [0.2, 0.5, 0.9]))}


def camera(value: Mapping | None) -> dict:
    """D7j: optional fields stay out if they are missing."""
    return {k: v for k, v in with_defaults(value, CAMERA).items() if v is not None}


def animation(value: Mapping | None) -> dict:
    """D7j, SRC16."""
    out = with_defaults(value, ANIMATION)
    out["keys"] = [camera(k) | {"duration": int(k.get("duration", 30)), "id": k.get("id") or f"key{i + 1}"} for i, k in enumerate(out["keys"])]
    return out


def project(value: Mapping | None) -> dict:
    """SRC14, D5j-D13j: a project at the current version, whatever it was at."""
    doc = dict(value or {})
    out = with_defaults(doc, PROJECT)
    out["layers"] = [with_defaults(x, {"kind": "point_cloud", "path": "", "visible": True, "style": None, "visual": ""}) | {"kind": enum("layer_kind", x.get("kind")), "style": style(x.get("style"))} for x in out["layers"]]
    out["visuals"] = [{"name": v.get("name", ""), "style": style(v.get("style"))} for v in out["visuals"]]
    out["shots"] = [camera(s) | {"duration": int(s.get("duration", 30))} for s in out["shots"]]
    out["paths"] = [animation(p) for p in out["paths"]]
    out["jobs"] = [_caches("render_job")(j) for j in out["jobs"]]
    out["emitters"] = [emitter(e) for e in out["emitters"]]
    out["regions"] = [region(r) for r in out["regions"]]
    out["ripple_layers"] = caustics_to_ripples(doc)
    out |= split_bundle(doc)
    for old in ("caustic_regions", "water_settings"):
        out.pop(old, None)
    return out | {"version": PROJECT_VERSION}


def sources(value: Mapping | None) -> dict:
    """SRC15."""
    doc = dict(value or {})
    return {"version": SOURCES_VERSION, "emitters": [emitter(e) for e in doc.get("emitters", [])], "regions": [region(r) for r in doc.get("regions", [])], "ripple_layers": caustics_to_ripples(doc), **split_bundle(doc)}


def style_preset(value: Mapping | None) -> dict:
    """SRC17."""
    doc = dict(value or {})
    return {"version": STYLE_VERSION, "name": doc.get("name", "Style"), "style": style(doc.get("style"))}


def _caches(kind: str):
    def parse(value: Mapping | None) -> dict:
        from cloudloom.sources import caches

        return getattr(caches, kind)(value)

    return parse


KINDS = {"path_cache": _caches("path_cache"), "render_job": _caches("render_job"), "project": project, "sources": sources, "style": style_preset, "animation": animation}


def loads(text: str | None, kind: str) -> tuple[dict | None, str | None]:
    """SRC12: the document, or why there is none."""
    try:
        value = json.loads(text or "")
    except ValueError as e:
        return None, str(e)
    return (KINDS[kind](value), None) if isinstance(value, dict) else (None, "not an object")


def save(document: Mapping, path: str) -> None:
    """SRC13: with two-space indents, folders made as needed."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2)


def load(path: str, kind: str) -> tuple[dict | None, str | None]:
    try:
        with open(path, encoding="utf-8") as f:
            return loads(f.read(), kind)
    except OSError as e:
        return None, str(e)


def parse_column(df: DataFrame, column: str, schema: str, defaults: Mapping[str, Any]) -> DataFrame:
    """SRC12 over a table: the JSON of a column as columns of ``schema``, with defaults and ``corrupt`` for what is no JSON."""
    parsed = F.from_json(column, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    out = df.withColumn("_doc", parsed)
    names = [c.split()[0] for c in schema.split(",")]
    fields = [F.coalesce(F.col(f"_doc.{n}"), F.lit(defaults[n])).alias(n) if n in defaults else F.col(f"_doc.{n}").alias(n) for n in names]
    return out.select(*[c for c in df.columns if c != column], *fields, (F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull()).alias("corrupt"))


def fingerprint(*settings: Mapping) -> str:
    """A hash of settings in a fixed order, to key what is cached."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def fingerprint_column(*columns: str) -> Column:
    """E91 over rows."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


#: Settings that a bake does not depend on.
RENDER_ONLY = ("smoothing", "trail_shape", "trail_width")


def same_bake(a: Mapping, b: Mapping) -> bool:
    """E92."""
    keep = lambda s: {k: v for k, v in s.items() if k not in RENDER_ONLY}
    return keep(a) == keep(b)


def import_camera(text: str) -> tuple[list[dict], str | None]:
    """SRC28: camera samples as keys: orientation given, else by target; field of view given, else by the lens; durations from frames."""
    from cloudloom.operators.camera import Camera, look_at_quaternion

    try:
        samples = sorted(json.loads(text)["samples"], key=lambda s: s["frame"])
    except (ValueError, KeyError, TypeError) as e:
        return [], str(e)
    keys = []
    for s, nxt in zip(samples, [*samples[1:], None]):
        at = tuple(s["position"])
        q = s.get("orientation") or look_at_quaternion(Camera(position=at, target=tuple(s.get("target", (0, 0, 0)))))
        fov = s.get("fov") or math.degrees(2 * math.atan(s.get("aperture", 41.4214) / s.get("aspect", 16 / 9) / (2 * s.get("focal_length", 50.0))))
        keys.append({"position": list(at), "orientation": list(q), "fov": fov, "duration": nxt["frame"] - s["frame"] if nxt else 0})
    return keys, None
