"""Styles as rows: predicates, the material ladder and the fast style.

A style is a struct column or plain columns; bindings are structs of (mode, constant, output_min, output_max, active).  Everything is an expression, so a table of styles is judged where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S

#: Below this a strength counts as none.
EPSILON = 1e-5
#: A role column of this or more marks the row.
ROLE = 0.5
#: Support points below this confidence are left out.
LEAST_CONFIDENCE = 0.56
BINDING = "struct<mode:string,constant:double,output_min:double,output_max:double,active:boolean>"


def binding(constant: Column | float, *, mode: Column | str = "constant", output_min: float = 0.0, output_max: Column | float = 1.0, active: Column | bool = True) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(mode).alias("mode"), as_column(constant).cast("double").alias("constant"), F.lit(output_min).alias("output_min"), as_column(output_max).cast("double").alias("output_max"), as_column(active).alias("active"))


def is_constant(b: Column) -> Column:
    """An inactive binding stands for its default, so it is constant too."""
    return ~b["active"] | (b["mode"] == "constant")


def uses_prepass(style: Column, scene_has_xray: Column | bool = True) -> Column:
    """something must write depth, and some style of the scene must ask for it."""
    asked = scene_has_xray if isinstance(scene_has_xray, Column) else F.lit(scene_has_xray)
    return asked & (style["depth_contribution"] != "none")


def has_xray(style: Column) -> Column:
    """a positive constant, or a mapping that reaches above zero."""
    b = style["xray_strength"]
    most = F.when(b["mode"] == "constant", b["constant"]).otherwise(F.greatest(b["output_min"], b["output_max"]))
    return b["active"] & (most > EPSILON)


def has_stylisation(style: Column) -> Column:
    return (style["stylisation"] != "off") & (style["stylisation_strength"] > EPSILON)


def has_motion(style: Column) -> Column:
    return (style["motion_amount"] > EPSILON) & (style["motion_speed"] > EPSILON)


def has_caustics(style: Column) -> Column:
    """switched on, visible in some way, and with all three of its fields there."""
    seen = (style["caustic_intensity"] > EPSILON) | (style["caustic_tint"] > EPSILON)
    return style["caustics_enabled"] & seen & style["caustic_fields"]


def world_sized(style: Column) -> Column:
    return (style["geometry_mode"] == "screen_sprites") & (style["sprite_size_mode"] == "world_millimeters")


def material(style: Column) -> Column:
    """the cheapest material that can draw the style: opaque_hard_disc, constant_simple or unified.

    Whatever moves or is stylised is unified.  Both cheap ones need a colour without a map, constant bindings, no fade with depth and no x-ray; the opaque one
    also full opacity, hard discs, no emission and no colourising.
    """
    moving = style["animated"] | has_stylisation(style) | has_motion(style) | has_caustics(style)
    plain = style["color_mode"].isin("source_rgb", "solid_color") & ~has_xray(style)
    for name in ("point_size", "surfel_diameter", "opacity", "emissive_strength", "colormap_position", "depth_fade"):
        plain = plain & is_constant(style[name])
    none = lambda b: ~b["active"] | (b["constant"] <= EPSILON)
    plain = plain & none(style["depth_fade"])
    opaque = ~style["opacity"]["active"] | (style["opacity"]["constant"] >= 1.0 - EPSILON)
    disc = (style["falloff"] == "hard_disc") & opaque & none(style["emissive_strength"]) & (style["colourise_amount"] <= EPSILON)
    return F.when(~moving & plain & disc, "opaque_hard_disc").when(~moving & plain, "constant_simple").otherwise("unified")


def fast_basic(style: Column, has_rgb: Column) -> Column:
    """The style of a quick picture: hard opaque sprites with the colour kept, nothing that costs."""
    mapped = style["color_mode"] == "scalar_colormap"
    sprites = style["geometry_mode"] == "screen_sprites"
    size_mode = F.when(sprites, style["sprite_size_mode"]).otherwise("pixels")
    default = lambda v: binding(v).cast(BINDING)
    return (
        style.withField("geometry_mode", F.lit("screen_sprites"))
        .withField("sprite_size_mode", size_mode)
        .withField("depth_contribution", F.lit("none"))
        .withField("falloff", F.lit("hard_disc"))
        .withField("stylisation", F.lit("off"))
        .withField("stylisation_strength", F.lit(0.0))
        .withField("motion_amount", F.lit(0.0))
        .withField("animated", F.lit(False))
        .withField("color_mode", F.when(mapped, "scalar_colormap").when(has_rgb, "source_rgb").otherwise("solid_color"))
        .withField("point_size", default(1.0))
        .withField("surfel_diameter", F.when(size_mode == "world_millimeters", style["surfel_diameter"].cast(BINDING)).otherwise(default(0.005)))
        .withField("opacity", default(1.0))
        .withField("emissive_strength", default(0.0))
        .withField("xray_strength", default(0.0))
        .withField("depth_fade", default(0.0))
        .withField("colormap_position", F.when(mapped, style["colormap_position"].cast(BINDING)).otherwise(default(0.5)))
    )


# Filters of rows


def of_role(rows: DataFrame, role: str, wanted: bool = True) -> DataFrame:
    """rows whose ``role`` column (particle_role, path_role, stream_role) marks them, or the others; a missing role is none."""
    marked = F.coalesce(F.col(role) >= ROLE, F.lit(False))
    return rows.where(marked if wanted else ~marked)


def confident(support: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """F15."""
    return support.where(F.col("confidence") >= least)


def enabled(emitters: DataFrame) -> DataFrame:
    """F16: all but those that are disabled; one without a status is accepted."""
    return emitters.where(F.coalesce("status", F.lit("accepted")) != "disabled")


def overlay_cloud(samples: DataFrame, fields: list[str]) -> DataFrame:
    """SRC29: overlay samples (x, y, z, normal, r, g, b in 0..1, fields) as the rows of a cloud: packed colour and scalar fields.

    Its field ranges and bounds are A1 and A2 over the result.
    """
    from cloudloom.functions.color import pack_rgb

    packed = pack_rgb(*[F.floor(S.clamp(F.col(c)) * 255.0 + 0.5) for c in "rgb"])
    return samples.select("point_index", "x", "y", "z", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))], packed.alias("packed"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in fields])
