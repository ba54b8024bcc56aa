"""Queries for scalar expressions, colours, geometry and pictures, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cloudloom.functions import color
from cloudloom.functions import scalar as S
from cloudloom.operators import camera, compose, raster, regions, sampling, spatial, splats, timeseries
from cloudloom.plans import views as V
from cloudloom.plans.queries import _M, C_SHAPE, _inside_sql, _round
from cloudloom.plans.registry import query

c = F.col
_U = "((point_index * 37 % 1000)::double / 999)"


def _u():
    return (c("point_index") * 37 % 1000) / 999


def _ss(lo, hi, x):
    t = f"least(greatest((({x}) - {lo}) / {hi - lo}::double, 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


# Bindings (E2-E7, A25, J2)

_LOHI = f"(SELECT min(v) AS lo, max(v) AS hi FROM {V.Q})"


def _range(q):
    r = q.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    return S.Stats(r["lo"], r["hi"])


@query("e2_input_range", f"SELECT point_index, round((v - 920) / 30, 6) AS own, round((v - lo) / greatest(hi - lo, 1e-5), 6) AS layer, round((v - 920) / 30, 6) AS unknown FROM {V.Q}, {_LOHI}")
def e2(spark, d):
    q = V.cloud_q(spark, d)
    st = _range(q)
    make = lambda flags, s: S.evaluate(S.Binding(field="v", lo=920.0, hi=950.0, flags=flags), stats=s)
    return _round(q.select("point_index", make(0, st).alias("own"), make(S.LAYER_STATS, st).alias("layer"), make(S.LAYER_STATS, S.Stats(0, 1, valid=False)).alias("unknown")))


@query("e3_gamma_guard", f"SELECT point_index, round(pow({_U}, 1e-4::double), 6) AS low, round({_U}, 6) AS one FROM {V.Q} WHERE {_U} > 0 UNION ALL SELECT point_index, 0.0::double, 0.0::double FROM {V.Q} WHERE {_U} = 0")
def e3(spark, d):
    make = lambda g: S.evaluate(S.Binding(field="u", gamma=g))
    return _round(V.cloud_q(spark, d).select("point_index", _u().alias("u")).select("point_index", make(-3.0).alias("low"), make(1.0).alias("one")))


@query(
    "e4_flags",
    f"SELECT point_index, round(n, 6) AS plain, round(1 - n, 6) AS inverted, round(least(greatest(n, 0), 1), 6) AS clamped, round(least(greatest(1 - n, 0), 1), 6) AS both FROM (SELECT point_index, (v - 930) / 20 AS n FROM {V.Q})",
)
def e4(spark, d):
    make = lambda flags: S.evaluate(S.Binding(field="v", lo=930.0, hi=950.0, flags=flags))
    names = {"plain": 0, "inverted": S.INVERT, "clamped": S.CLAMP, "both": S.CLAMP | S.INVERT}
    return _round(V.cloud_q(spark, d).select("point_index", *[make(f).alias(n) for n, f in names.items()]))


@query("e5_configure", f"SELECT point_index, round(least(greatest((v - lo) / greatest(hi - lo, 1e-5), 0), 1), 6) AS known, round(least(greatest(v, 0), 1), 6) AS unknown FROM {V.Q}, {_LOHI}")
def e5(spark, d):
    q = V.cloud_q(spark, d)
    old = S.Binding(constant=3.0, gamma=2.5, flags=S.INVERT)
    return _round(q.select("point_index", S.evaluate(S.configure(old, "v", _range(q))).alias("known"), S.evaluate(S.configure(old, "v", None)).alias("unknown")))


@query("e6_inactive_defaults", f"SELECT point_index, 1.0::double AS point_size, 0.005::double AS surfel_diameter, 1.0::double AS opacity, 0.0::double AS emission, 0.0::double AS xray, 0.0::double AS depth_fade, 0.5::double AS colormap_position, round(least(greatest(v, 0), 1), 6) AS active FROM {V.Q}")
def e6(spark, d):
    off = S.Binding(field="v", active=False)
    return _round(V.cloud_q(spark, d).select("point_index", *[S.with_default(off, role).alias(role) for role in S.INACTIVE], S.with_default(S.Binding(field="v"), "opacity").alias("active")))


@query("e7_field_value", f"SELECT point_index, v AS present, 0.0::double AS missing, CASE WHEN point_index % 2 = 0 THEN v ELSE 0 END AS null_is_0 FROM {V.Q}")
def e7(spark, d):
    q = V.cloud_q(spark, d).withColumn("half", F.when(c("point_index") % 2 == 0, c("v")))
    return q.select("point_index", *[S.field_value(q.columns, n).alias(a) for n, a in (("v", "present"), ("nowhere", "missing"), ("half", "null_is_0"))])


@query("j2_field_slots", "SELECT * FROM (VALUES ('by_slot', 'y'), ('by_name', 'brand'), ('none', NULL)) t(kind, field)")
def j2(spark, d):
    names = V.cloud_q(spark, d).columns
    return spark.createDataFrame([("by_slot", S.resolve_field(names, 2, "brand")), ("by_name", S.resolve_field(names, -1, "brand")), ("none", S.resolve_field(names, 99, "zzz"))], "kind string, field string")


@query("a25_inactive_count", "SELECT s_suppkey, ((s_suppkey % 2 = 0)::int + (s_suppkey % 3 = 0)::int + (s_suppkey % 5 = 0)::int)::int AS inactive FROM supplier")
def a25(spark, d):
    k = c("s_suppkey")
    off = [k % m == 0 for m in (2, 3, 5)]
    s = V.table(spark, d, "supplier").select("s_suppkey", F.array(*[F.struct((~x).alias("active")) for x in off]).alias("bindings"))
    return s.select("s_suppkey", S.inactive_count_column(c("bindings")).alias("inactive"))


# Curves, hashes, waves


@query("e12_exponential", f"SELECT point_index, round((exp(3.0::double * {_U}) - 1) / (exp(3.0::double) - 1), 9) AS fire, round((exp(2.7::double * {_U}) - 1) / (exp(2.7::double) - 1), 9) AS ice FROM {V.Q}")
def e12(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", *[color.exponential(_u(), color.EXPONENTS[f"exponential_{n}"]).alias(n) for n in ("fire", "ice")]), 9)


@query("e55_smoothstep", f"SELECT point_index, round({_ss(0.2, 0.7, _U)}, 6) AS guarded, round(1 - {_ss(0.2, 0.7, _U)}, 6) AS reversed, (CASE WHEN {_U} < 0.5 THEN 0 ELSE 1 END)::double AS step FROM {V.Q}")
def e55(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.smoothstep(0.2, 0.7, _u()).alias("guarded"), S.smoothstep_any(0.7, 0.2, _u()).alias("reversed"), S.smoothstep_any(0.5, 0.5, _u()).alias("step")))


@query("f14_finite", f"SELECT point_index FROM {V.Q} WHERE point_index % 5 IN (0, 4)")
def f14(spark, d):
    k = c("point_index") % 5
    x = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).when(k == 3, F.lit(None)).otherwise(c("x"))
    return V.cloud_q(spark, d).withColumn("x", x).where(S.is_finite(c("x"))).select("point_index")


_RH = lambda a, b, s: f"xor(xor((({a})::hugeint * 747796405 % 4294967296)::bigint, (({b})::hugeint * 2891336453 % 4294967296)::bigint), (({s})::hugeint * 277803737 % 4294967296)::bigint)"


@query("e51_cell_noise", f"SELECT o_orderkey, ({S.hash32_sql(_RH('o_custkey % 50', 'o_orderkey % 50', '12'))} & 16777215) / 16777215.0::double AS n FROM orders")
def e51(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", S.cell_noise(c("o_custkey") % 50, c("o_orderkey") % 50, F.lit(5), salt=7).alias("n"))


@query("e52_trig_hash", f"SELECT point_index, round(h - floor(h), 4) AS h FROM (SELECT point_index, sin(point_index::double / 7) * 43758.5453123 AS h FROM {V.Q})")
def e52(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.trig_hash(c("point_index") / 7).alias("h")), 4)


def _lattice(dx, dy):
    h = f"(sin((floor(x / 3) + {dx}) * 127.1::double + (floor(z / 5) + {dy}) * 311.7::double + 2 * 74.7::double) * 43758.5453123::double)"
    return f"({h} - floor({h}))"


@query(
    "e53_block_noise",
    f"""WITH l AS (SELECT point_index, x / 3 - floor(x / 3) AS u, z / 5 - floor(z / 5) AS w, {_lattice(0, 0)} AS a, {_lattice(1, 0)} AS b, {_lattice(0, 1)} AS c, {_lattice(1, 1)} AS e FROM {V.Q}), f AS (SELECT *, u * u * (3 - 2 * u) AS s, w * w * (3 - 2 * w) AS t FROM l)
    SELECT point_index, round((a + (b - a) * s) + ((c + (e - c) * s) - (a + (b - a) * s)) * t, 4) AS n FROM f""",
)
def e53(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.block_noise(c("x") / 3, c("z") / 5, 2.0).alias("n")), 4)


@query("e50_screen", f"SELECT point_index, round(1 - (1 - least(greatest(x / 40, 0), 1)) * (1 - {_U}), 6) AS s FROM {V.Q}")
def e50(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", compose.screen(c("x") / 40, _u()).alias("s")))


@query("e90_response", f"SELECT point_index, round(0.2 + 0.6 * least(greatest(x / 40, 0), 1), 6) AS r FROM {V.Q}")
def e90(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", compose.response(c("x") / 40, 0.2, 0.8).alias("r")))


# Colours (E10, E17, E19, J20)

# Published colours of the perceptual maps at each fifteenth of 256 places.
_PUBLISHED = {
    "viridis": "440154 481769 472A7A 433D84 3D4E8A 355E8D 2E6D8E 297B8E 23898E 1F978B 21A585 2EB37C 46C06F 65CB5E 89D548 B0DD2F D8E219 FDE725",
    "plasma": "0D0887 2F0596 4903A0 6100A7 7801A8 8E0CA4 A21D9A B42E8D C43E7F D24F71 DE6164 E97257 F3854B F99A3E FDAF31 FDC627 F8DF25 F0F921",
    "inferno": "000004 0A0722 1E0C45 380962 510E6C 69166E 801F6C 982766 B0315B C63D4D D94D3D E9612B F47918 FA9407 FCB014 F8CD37 F2EA69 FCFFA4",
    "magma": "000004 090720 1A1042 311165 4A1079 621980 792282 912B81 AA337D C23B75 D9466B EC5860 F7725C FC8E64 FEAA74 FEC68A FDE2A3 FCFDBF",
    "cividis": "00224E 002D68 163770 2E416D 3F4C6C 4E566C 5C616E 696B71 767676 838179 928C78 A09875 AFA471 BFB06B CFBD62 DFCA57 F0D846 FEE838",
    "turbo": "30123B 3F3E9C 4666DD 458CFD 2FB2F4 1AD4D0 22EBAA 52FA7A 8BFF4B B7F735 DBE236 F5C53A FEA130 F9751D E84B0C CE2D04 A91601 7A0403",
}


def _hex(name):
    return "[" + ", ".join(f"'{k}'" for k in _PUBLISHED[name].split()) + "][point_index % 18 + 1]"


@query("j20_perceptual_colormaps", f"SELECT point_index, {', '.join(f'{_hex(n)} AS {n}' for n in _PUBLISHED)} FROM {V.Q}")
def j20(spark, d):
    """Every perceptual map at the places whose published colours the SQL lists."""
    t = (c("point_index") % 18) * 15 / 255.0
    text = lambda rgb: F.concat(*[F.lpad(F.hex(S.to_byte(x).cast("long")), 2, "0") for x in rgb])
    return V.cloud_q(spark, d).select("point_index", *[text(color.colormap(n, t)).alias(n) for n in _PUBLISHED])


@query("e17_point_colour", f"SELECT point_index, round(CASE point_index % 3 WHEN 0 THEN 0.2 WHEN 1 THEN {_U} ELSE 0.5 END * 0.75 + 0.25, 6) AS r, round(CASE point_index % 3 WHEN 0 THEN 0.4 WHEN 1 THEN {_U} ELSE 0.6 END * 0.75, 6) AS g FROM {V.Q}")
def e17(spark, d):
    k = c("point_index") % 3
    effect = tuple(F.lit(x) for x in (1.0, 0.0, 0.0))
    source = tuple(F.lit(x) for x in (0.2, 0.4, 0.0))
    of = {m: color.point_colour(m, source=source, solid=(0.5, 0.6, 0.7), position=_u(), map_name="custom_gradient", effect=effect, effect_mix=0.25) for m in ("source", "colormap", "solid")}
    pick = lambda i: F.when(k == 0, of["source"][i]).when(k == 1, of["colormap"][i]).otherwise(of["solid"][i])
    return _round(V.cloud_q(spark, d).select("point_index", pick(0).alias("r"), pick(1).alias("g")))


_BLUE = "[0.05, 0.08, 0.12, 0.25, 0.48, 0.78][least(floor(h * 6)::int, 5) + 1]::double"


@query("e19_particle_palette", f"SELECT o_orderkey, {_BLUE} AS r FROM (SELECT o_orderkey, ({S.hash32_sql('o_orderkey')} & 16777215) / 16777215.0::double AS h FROM orders)")
def e19(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", color.particle_colour(c("o_orderkey"))[0].alias("r"))


# Splats and geometry (E21-E28, E71-E76, AR1)


@query("e21_scale_quaternion", f"SELECT point_index, round(exp(least(greatest(scale[3], -16), 16)), 6) AS scale_z, round(rot[4] / sqrt(list_sum(list_transform(rot, lambda v: v * v))), 6) AS rot_z, round(1 / (1 + exp(-opacity)), 6) AS opacity FROM {V.SPLATS}")
def e21(spark, d):
    s = splats.decode(V.splats(spark, d))
    return _round(s.select("point_index", c("scale")[2].alias("scale_z"), c("rot")[3].alias("rot_z"), "opacity"))


@query("e22_identity_quaternion", f"SELECT point_index, 1.0::double AS w, 0.0::double AS x FROM {V.SPLATS}")
def e22(spark, d):
    q = S.unit_quaternion([F.lit(0.0)] * 4)
    return V.splats(spark, d).select("point_index", q[0].alias("w"), q[1].alias("x"))


_NRM = "sqrt(pow(x / 2, 2) + pow(y / 3, 2) + pow(z / 4, 2))"


@query("e24_normal_transform", f"SELECT point_index, round(x / 2 / {_NRM}, 6) AS nx, round(y / 3 / {_NRM}, 6) AS ny, round(z / 4 / {_NRM}, 6) AS nz FROM {V.SPLATS}")
def e24(spark, d):
    n = S.transform_normal(S.vec("x", "y", "z"), _M)
    return _round(V.splats(spark, d).select("point_index", *[v.alias(a) for v, a in zip(n, ("nx", "ny", "nz"))]))


@query("e27_surfel_basis", f"SELECT point_index, 0.0::double AS along_n, 0.0::double AS across, 1.0::double AS length, round(CASE WHEN abs(x) / n > 0.99 THEN -y * x / (n * n) / sqrt(1 - pow(y / n, 2)) ELSE (1 - pow(x / n, 2)) / sqrt(1 - pow(x / n, 2)) END, 6) AS ux FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM {V.SPLATS})")
def e27(spark, d):
    """The basis is square to the normal and to itself; u leans to x unless that is the normal."""
    s = S.staged(V.splats(spark, d), n=S.normalise(S.vec("x", "y", "z")))
    s = raster.surfel_basis(s, S.vec("x", "y", "z"))
    return _round(s.select("point_index", S.dot(S.at("u"), S.at("n")).alias("along_n"), S.dot(S.at("u"), S.at("v")).alias("across"), S.length(S.at("v")).alias("length"), c("u_x").alias("ux")))


@query("e28_pixel_size", f"SELECT point_index, round(0.02 * 1.5 * 480 / (2 * greatest(x / 10, 0.001)), 6) AS px FROM {V.Q}")
def e28(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.world_to_pixels(0.02, -1.5, 480, c("x") / 10).alias("px")))


@query("e26_plane_distance", f"SELECT point_index, round(0.6 * x + 0.8 * z - 2, 6) AS d FROM {V.Q}")
def e26(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.plane_distance(S.vec("x", "y", "z"), [0.6, 0.0, 0.8, -2.0]).alias("d")))


@query("e47_downhill_score", f"SELECT point_index, round(3.2 * x / greatest(y / 1000, 0.02) + 1.9 * {_U} + 1.6 * 0.5 + 0.55 * 0.25 - 0.1 - 0.2 + 0.22 * 0.3 * 0.4, 6) AS s FROM {V.Q}")
def e47(spark, d):
    lit = F.lit
    return _round(V.cloud_q(spark, d).select("point_index", S.downhill_score(c("x"), c("y") / 1000, _u(), lit(0.5), lit(0.25), lit(0.1), lit(0.2), lit(0.3), 0.4).alias("s")))


@query("e71_support_confidence", f"SELECT point_index, round(least(greatest((0.72 + CASE WHEN point_index % 2 = 0 THEN 0.18 ELSE -0.22 END) * (0.35 + 0.65 * {_U}), 0), 1), 6) AS c FROM {V.Q}")
def e71(spark, d):
    up = F.when(c("point_index") % 2 == 0, 1.0).otherwise(0.0)
    return _round(V.cloud_q(spark, d).select("point_index", S.support_confidence((F.lit(0.0), F.lit(0.0), up), _u()).alias("c")))


@query("e72_flow_direction", f"SELECT point_index, round(CASE WHEN {_U} > 0 THEN sqrt(1 - pow({_U}, 2)) ELSE 0 END, 5) AS dx, round(CASE WHEN {_U} > 0 THEN -{_U} ELSE -1 END, 5) AS dz FROM {V.Q} WHERE {_U} > 0.01")
def e72(spark, d):
    """The slope's angle is that of its normal (u, 0, sqrt(1 - u^2))."""
    n = (_u(), F.lit(0.0), F.sqrt(1.0 - _u() * _u()))
    q = S.staged(V.cloud_q(spark, d).where(_u() > 0.01), n=n)
    f = S.flow_direction(S.at("n"))
    return _round(q.select("point_index", f[0].alias("dx"), f[2].alias("dz")), 5)


@query("e73_lateral", f"SELECT point_index, CASE WHEN point_index % 2 = 0 THEN 0.0 ELSE 1.0 END::double AS lx, CASE WHEN point_index % 2 = 0 THEN 1.0 ELSE 0.0 END::double AS ly FROM {V.Q}")
def e73(spark, d):
    zero, up = F.lit(0.0), F.lit(1.0)
    side = S.lateral((zero, zero, up), (F.when(c("point_index") % 2 == 0, 2.0).otherwise(0.0), zero, zero))
    return _round(V.cloud_q(spark, d).select("point_index", side[0].alias("lx"), side[1].alias("ly")))


@query("e74_edge_distance", f"SELECT point_index, round(sqrt(pow(greatest(x - 45, 5 - x, 0), 2) + pow(greatest(y - 990, 905 - y, 0), 2)), 5) AS d FROM {V.Q} WHERE x < 5 OR x > 45")
def e74(spark, d):
    """To a rectangle's edges in XY, from outside its sides."""
    box = [(5.0, 905.0, 0.0), (45.0, 905.0, 0.0), (45.0, 990.0, 0.0), (5.0, 990.0, 0.0)]
    flat = V.cloud_q(spark, d).where("x < 5 or x > 45").withColumn("z", F.lit(0.0))
    return _round(flat.select("point_index", regions.edge_distance(S.vec("x", "y", "z"), box).alias("d")), 5)


@query("e75_grid_key", f"SELECT point_index, floor((x - 25) / 3)::bigint AS k, floor(y / 0.0001::double)::bigint AS tiny FROM {V.Q}")
def e75(spark, d):
    return V.cloud_q(spark, d).select("point_index", S.grid_key(c("x") - 25, 3.0).alias("k"), S.grid_key(c("y"), 0.0).alias("tiny"))


@query("e76_voxel_centre", f"SELECT point_index, k::bigint AS k, round(1 + (k + 0.5) / 8 * 49, 6) AS centre, 25.5::double AS one FROM (SELECT point_index, floor(least(greatest((x - 1) / 49, 0), 0.999999999999) * 8) AS k FROM {V.Q})")
def e76(spark, d):
    lo, extent = F.lit(1.0), F.lit(49.0)
    k = S.voxel(c("x"), lo, extent, 8)
    return _round(V.cloud_q(spark, d).select("point_index", k.alias("k"), S.voxel_centre(k, lo, extent, 8).alias("centre"), S.voxel_centre(F.lit(0), lo, extent, 1).alias("one")))


@query("ar1_vectors", f"SELECT point_index, round(x * z + y * x + z * y, 6) AS dot, round(y * y - z * x, 6) AS cross_x, round(sqrt(x * x + y * y + z * z), 6) AS length FROM {V.Q}")
def ar1(spark, d):
    a, b = S.vec("x", "y", "z"), S.vec("z", "x", "y")
    return _round(V.cloud_q(spark, d).select("point_index", S.dot(a, b).alias("dot"), S.cross(a, b)[0].alias("cross_x"), S.length(a).alias("length")))


# Compositing and playback


@query("e83_xray_alpha", f"SELECT point_index, round(CASE WHEN point_index % 3 = 0 OR x <= 25 THEN 0.9 ELSE 0.35 * exp(-(x - 25) * 0.2) END, 6) AS a FROM {V.Q}")
def e83(spark, d):
    scene = F.when(c("point_index") % 3 != 0, 25.0)
    return _round(V.cloud_q(spark, d).select("point_index", S.xray_alpha(c("x"), scene, 0.9, 0.35, 0.2).alias("a")))


@query("f17_depth_writes", f"SELECT point_index, false AS none, {_U} >= 0.5 AS threshold, true AS always FROM {V.Q}")
def f17(spark, d):
    return V.cloud_q(spark, d).select("point_index", *[S.alpha_writes_depth(m, _u(), 0.5).alias(m) for m in ("none", "threshold", "always")])


@query("f20_depth_compatible", f"SELECT point_index, point_index % 4 = 0 OR abs(x - z) <= greatest(2.0, 0.1 * greatest(x, z)) AS ok FROM {V.Q}")
def f20(spark, d):
    other = F.when(c("point_index") % 4 != 0, c("z"))
    return V.cloud_q(spark, d).select("point_index", S.depth_compatible(c("x"), other, 2.0, 0.1).alias("ok"))


@query("e84_particle_fade", f"SELECT point_index, round({_ss(0.0, 0.08, _U)} * (1 - {_ss(0.86, 1.0, _U)}), 6) AS f FROM {V.Q}")
def e84_fade(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.particle_fade(_u()).alias("f")))


@query("e89_composite_pixel", f"SELECT ix, iy, round((r * 0.5 / 0.5) * (1 - 0.25) + 1 - exp(-b) + 0.1 * 0.25, 6) AS r, 0.75::double AS alpha FROM {V.PIXELS}")
def e89(spark, d):
    p = V.pixels(spark, d)
    sums = p.select("ix", "iy", *[(c(k) * 0.5).alias(k) for k in "rgb"], F.lit(0.5).alias("w"), F.lit(0.25).alias("through"), "depth", c("b").alias("er"), c("b").alias("eg"), c("b").alias("eb"))
    return _round(raster.composite(sums, (0.1, 0.1, 0.1)).select("ix", "iy", "r", "alpha"))


@query("x1_playback", f"SELECT point_index, round(({_U} + 0.5 * 2.0 * 0.12 + 1) % 1, 6) AS t0, round(({_U} + 1.5 * 2.0 * 0.12 + 1) % 1, 6) AS t1 FROM {V.Q}")
def x1(spark, d):
    """Two times of the same rows: nothing but an expression changes."""
    return _round(V.cloud_q(spark, d).select("point_index", *[S.particle_travel(_u(), t, F.lit(2.0)).alias(n) for n, t in (("t0", 0.5), ("t1", 1.5))]))


@query("x2_params_only", "SELECT l_orderkey, l_linenumber, round(least(1, l_discount * 10 * 0.5), 6) AS before, round(least(1, l_discount * 10 * 0.9), 6) AS after FROM lineitem")
def x2(spark, d):
    m = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("edge_weight"), F.lit(0).alias("param_index"))
    one = [F.lit(1.0).alias(f"{x}_response") for x in ("emission", "opacity", "size", "mix")]
    at = lambda rows, k: compose.contribute(rows, spark.range(1).select(c("id").cast("int").alias("param_index"), F.lit(k).alias("intensity"), F.lit(0.0).alias("phase"), F.lit(0.0).alias("speed"), F.lit("linear").alias("pattern"), *one), 0.0, F.lit(1.0))
    before = at(m, 0.5).select(*m.columns, c("value").alias("before"))
    return _round(at(before, 0.9).select("l_orderkey", "l_linenumber", "before", c("value").alias("after")))


# Names and frames (E39, E41-E45, ST1, SRC3)


@query("e39_frames_for_speed", f"SELECT point_index, greatest(ceil(x / 2.5 * 30)::bigint, point_index % 7 - 1) AS n FROM {V.Q}")
def e39(spark, d):
    return V.cloud_q(spark, d).select("point_index", S.frames_for_speed(c("x"), 2.5, c("point_index") % 7).alias("n"))


@query("e41_visual_names", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Visual' WHEN 1 THEN s_name WHEN 2 THEN s_name || ' (edited)' ELSE s_name || ' (edited)' END AS name FROM supplier")
def e41(spark, d):
    k = c("s_suppkey") % 4
    raw = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" "), c("s_name"), F.lit(" "))).when(k == 2, F.concat(c("s_name"), F.lit(" (edited)"))).otherwise(F.concat(c("s_name"), F.lit(" [Edited] (EDITED)")))
    return V.table(spark, d, "supplier").select("s_suppkey", S.visual_name(raw).alias("name"))


@query("e42_field_keys", "SELECT p_partkey, lower(regexp_replace(p_name || ' #' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS k FROM part")
def e42(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.field_key(F.concat("p_name", F.lit(" #"), "p_brand")).alias("k"))


@query("src3_display_names", "SELECT p_partkey, p_brand AS name FROM part")
def src3(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.display_name(F.concat(F.lit("scalar_"), "p_brand", F.lit("\r\n"))).alias("name"))


@query("e43_camera_moves", f"SELECT * FROM (VALUES ('dolly', 0.0::double, {-5 * math.exp(-0.15)!r}::double, 0.0::double), ('dolly_most', 0.0, {-5 * math.exp(-0.6)!r}, 0.0), ('pan', 2.0, -5.0, 1.0), ('orbit', 5.0, 0.0, 0.0)) t(move, x, y, z)")
def e43(spark, d):
    start = camera.Camera(position=(0.0, -5.0, 0.0))
    moved = {"dolly": camera.dolly(start, 2.0), "dolly_most": camera.dolly(start, 99.0), "pan": camera.pan(start, 2.0, 1.0), "orbit": camera.orbit(start, 90.0, 0.0)}
    return _round(spark.createDataFrame([(n, *[float(v) for v in m.position]) for n, m in moved.items()], "move string, x double, y double, z double"), 9)


_F50 = 1 / math.tan(math.radians(25))


@query("e45_view_projection", f"SELECT point_index, round(x * {_F50!r}::double / (16 / 9::double), 6) AS cx, round(-z * {_F50!r}::double, 6) AS cy, round(y + 5, 6) AS w FROM {V.Q}")
def e45(spark, d):
    """A camera at (0, -5, 0) that looks along y: x goes right, z up, and w is the way ahead."""
    vp = camera.view_projection(camera.Camera((0.0, -5.0, 0.0)), 1600, 900)
    k = S.clip(S.vec("x", "y", "z"), vp)
    return _round(V.cloud_q(spark, d).select("point_index", k[0].alias("cx"), k[1].alias("cy"), k[3].alias("w")))


@query("e29_straight_spline", f"SELECT point_index, round(1 + 2 * least(greatest({_U} * 5, 0), 4), 6) AS s, round(CASE WHEN t < 1 THEN 1.5 * t - 0.5 * t * t * t ELSE 1 - 1.5 * (t - 1) * (t - 1) + 0.5 * (t - 1) * (t - 1) * (t - 1) END, 6) AS bump FROM (SELECT point_index, least({_U} * 2, 2) AS t FROM {V.Q})")
def e29_straight(spark, d):
    """On a line the natural spline is the line; through 0, 1, 0 it is the cubic with second derivatives 0, -3, 0."""
    q = V.cloud_q(spark, d).select("point_index", _u().alias("u"))
    return _round(q.select("point_index", timeseries.spline_column(c("u") * 5, [0, 1, 3, 4], [1, 3, 7, 9]).alias("s"), timeseries.spline_column(c("u") * 2, [0, 1, 2], [0, 1, 0]).alias("bump")))


@query("e30_path_evaluate", f"SELECT point_index, round(2 * t, 6) AS x, round(5 - t, 6) AS y, round(50 + 3 * t, 6) AS fov FROM (SELECT point_index, {_U} * 3 AS t FROM {V.Q})")
def e30(spark, d):
    keys = [{"knot": k, "x": 2.0 * k, "y": 5.0 - k, "fov": 50 + 3.0 * k} for k in (0.0, 1.0, 2.5, 3.0)]
    times = V.cloud_q(spark, d).select("point_index", (_u() * 3).alias("t"))
    return _round(timeseries.evaluate_path(times, keys, ["x", "y", "fov"]).select("point_index", "x", "y", "fov"))


@query("e32_shot_between", f"SELECT point_index, round(10 * {_U}, 6) AS x, round(40 + 20 * {_U}, 6) AS fov, round(sin({_U} * pi() / 4), 6) AS qz FROM {V.Q}")
def e32(spark, d):
    half = math.sqrt(0.5)
    a = {"x": 0.0, "y": 0.0, "z": 0.0, "tx": 0.0, "ty": 0.0, "tz": 0.0, "fov": 40.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0}
    b = a | {"x": 10.0, "fov": 60.0, "qz": -half, "qw": -half}  # the other sign is the same turn
    q = V.cloud_q(spark, d).select("point_index", _u().alias("t"), *[F.lit(v).alias(f"{n}_{k}") for n, s in (("a", a), ("b", b)) for k, v in s.items()])
    return _round(timeseries.shot_between(q).select("point_index", "x", "fov", "qz"))


# Filters and samples


@query("f2_bounds_prefilter", f"SELECT point_index FROM {V.Q} WHERE x BETWEEN 5 AND 45 AND y BETWEEN 905 AND 990")
def f2(spark, d):
    return V.cloud_q(spark, d).where(regions.in_bounds(c("x"), c("y"), C_SHAPE)).select("point_index")


@query("f4_frustum_planes", "SELECT * FROM (VALUES (0, 1.0::double, 0.0::double, 0.0::double, 1.0::double), (1, -1.0, 0.0, 0.0, 5.0), (2, 0.0, 1.0, 0.0, 2.0), (3, 0.0, -1.0, 0.0, 4.0), (4, 0.0, 0.0, 1.0, 100.0), (5, 0.0, 0.0, -1.0, 100.0)) t(plane, a, b, c, d)")
def f4(spark, d):
    view = [1 / 3, 0, 0, -2 / 3, 0, 1 / 3, 0, -1 / 3, 0, 0, 1 / 100, 0, 0, 0, 0, 1]  # x in -1..5, y in -2..4
    return _round(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(sampling.frustum_planes(view))], "plane int, a double, b double, c double, d double"), 9)


@query(
    "f6_frustum_cells",
    f"""WITH b AS (SELECT min(x) AS lx, max(x) - min(x) AS ex, min(y) AS ly, max(y) - min(y) AS ey FROM {V.Q}),
    k AS (SELECT point_index, floor(least(greatest((x - lx) / ex, 0), 0.999999999999) * 16) AS cx, floor(least(greatest((y - ly) / ey, 0), 0.999999999999) * 16) AS cy, b.* FROM {V.Q}, b)
    SELECT point_index FROM k WHERE lx + (cx + 2) * ex / 16 >= 5 AND lx + (cx - 1) * ex / 16 <= 15 AND ly + (cy + 2) * ey / 16 >= 925 AND ly + (cy - 1) * ey / 16 <= 935""",
)
def f6_cells(spark, d):
    """A box view takes the points of the cells that it touches, grown by one."""
    kept, masked = sampling.frustum_union(V.cloud_q(spark, d), [camera.orthographic(10.0, 930.0, 5.0)], 16)
    assert masked
    return kept.select("point_index")


@query("f7_depth_cull", f"SELECT point_index, round(y + 5, 6) AS depth FROM {V.FLAT_Q} WHERE y + 5 > 5.2::double AND y + 5 < 5.7::double AND abs(x * {_F50!r}::double) <= y + 5")
def f7(spark, d):
    """Between the planes and in front; the picture's sides are tested pixel by pixel."""
    vp = camera.view_projection(camera.Camera((0.0, -5.0, 0.0)), 100, 100)
    kept = raster.project(V.flat_q(spark, d), vp, 100, 100, near=5.2, far=5.7)
    return _round(kept.where("px between 0 and 100").select("point_index", "depth"))


@query("f12_boundary_clean", "SELECT layer_id, n FROM (VALUES (1::bigint, 4), (2, 3), (3, 3), (4, 3), (5, 2)) t(layer_id, n)")
def f12(spark, d):
    from cloudloom.plans.queries import _layers

    return _layers(spark).select("layer_id", F.size(regions.boundary_column(c("vertices"))).alias("n"))


@query("s1_budgets", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE least(s_suppkey % 5 * 10, greatest(1, s_suppkey % 30)) END::bigint AS n FROM supplier")
def s1(spark, d):
    k = c("s_suppkey")
    return V.table(spark, d, "supplier").select("s_suppkey", sampling.clamp_budget_column(k % 5 * 10, k % 30).cast("long").alias("n"))


@query("s6_convex_hull", "SELECT * FROM (VALUES (0, 0.0::double, 0.0::double), (1, 4.0, 0.0), (2, 4.0, 4.0), (3, 0.0, 4.0)) t(seq, x, y)")
def s6(spark, d):
    """Of the suppliers' places on a lattice, with repeats and points on the edges."""
    k = c("s_suppkey")
    at = V.table(spark, d, "supplier").select((k % 5).cast("double").alias("x"), (F.floor(k / 5) % 5).cast("double").alias("y")).distinct().collect()
    return spark.createDataFrame([(i, *p) for i, p in enumerate(sampling.convex_hull([tuple(r) for r in at]))], "seq int, x double, y double")


@query("s10_lod_budget", f"SELECT mode, moving, CASE WHEN mode = 'force' OR (mode = 'auto' AND moving) THEN least(n, 1000) ELSE n END AS drawn FROM (SELECT count(*) AS n FROM {V.P}), (VALUES ('full'), ('auto'), ('force')) m(mode), (VALUES (true), (false)) v(moving)")
def s10(spark, d):
    n = V.cloud_p(spark, d).count()
    rows = [(m, moving, sampling.lod_budget(n, m, 1000, moving)) for m in ("full", "auto", "force") for moving in (True, False)]
    return spark.createDataFrame(rows, "mode string, moving boolean, drawn long")


@query("a21_depth_histogram", f"SELECT bucket, count(*) AS n FROM (SELECT least(floor((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) * 63), 63)::int AS bucket FROM {V.SPLATS}) GROUP BY 1")
def a21(spark, d):
    s = V.splats(spark, d).select(c("point_index").alias("merged_index"), c("z").alias("view_depth"))
    return sampling.back_to_front(s, 64).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


# Pictures (R1-R5, R8, R12, R14-R17, A26)


@query("r1_full_image", f"SELECT (i % 70)::int AS ix, (i // 70)::int AS iy, coalesce(r, 0)::double AS r, coalesce(alpha, 0)::double AS alpha, p.depth IS NULL AS empty FROM range(70 * 40) t(i) LEFT JOIN {V.PIXELS} p ON p.ix = i % 70 AND p.iy = i // 70")
def r1(spark, d):
    out = raster.full_image(V.pixels(spark, d), 70, 40)
    return out.select("ix", "iy", "r", "alpha", (c("depth") == float("inf")).alias("empty"))


@query("r2_tiles", "SELECT (x * 512)::int AS x, (y * 512)::int AS y, least(512, 1920 - x * 512)::int AS width, least(512, 1080 - y * 512)::int AS height FROM range(4) a(x), range(3) b(y)")
def r2(spark, d):
    return spark.createDataFrame(raster.tiles(1920, 1080), "x int, y int, width int, height int")


@query("r4_cover_sprites", f"SELECT point_index, count(*) AS n, round(max(reach), 6) AS reach FROM (SELECT point_index, sqrt(pow(i + 0.5 - px, 2) + pow(j + 0.5 - py, 2)) / r AS reach FROM (SELECT point_index, x AS px, z / 2 AS py, least(greatest(0.25 + (point_index % 4) * 0.7::double, 0.5), 32) AS r FROM {V.Q}), range(0, 48) a(i), range(0, 48) b(j)) WHERE reach <= 1 GROUP BY 1")
def r4(spark, d):
    q = V.cloud_q(spark, d).select("point_index", c("x").alias("px"), (c("z") / 2).alias("py"), (0.25 + c("point_index") % 4 * 0.7).alias("radius"))
    return _round(raster.cover(q, 48, 48).groupBy("point_index").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")))


@query("r3_pixel_of", f"SELECT point_index, floor(x)::int AS ix, floor(z / 2)::int AS iy FROM {V.Q} WHERE x < 40 AND z / 2 < 40")
def r3(spark, d):
    q = V.cloud_q(spark, d).select("point_index", c("x").alias("px"), (c("z") / 2).alias("py"))
    return raster.pixel_of(q, 40, 40).select("point_index", "ix", "iy")


@query("r5_surfel_hits", f"SELECT point_index, ix, iy, round(10 - z / 97, 6) AS depth, round(sqrt(pow((ix - x) / 1.5, 2) + pow((iy - y0) / 2.5, 2)), 6) AS reach FROM (SELECT point_index, x, (point_index % 50)::double AS y0, z FROM {V.Q}), range(0, 60) a(ix), range(0, 60) b(iy) WHERE sqrt(pow((ix - x) / 1.5, 2) + pow((iy - y0) / 2.5, 2)) <= 1")
def r5(spark, d):
    """Rays straight down on level surfels: the depth is the height above, the reach an ellipse."""
    y = (c("point_index") % 50).cast("double")
    s = V.cloud_q(spark, d).select("point_index", "x", y.alias("y"), (c("z") / 97).alias("z"), *[F.lit(v).alias(n) for n, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0), ("ux", 1.0), ("uy", 0.0), ("uz", 0.0), ("vx", 0.0), ("vy", 1.0), ("vz", 0.0), ("ru", 1.5), ("rv", 2.5))])
    s = s.withColumns({"ix0": F.floor(c("x") - 2).cast("int"), "ix1": F.ceil(c("x") + 2).cast("int"), "iy0": F.floor(c("y") - 3).cast("int"), "iy1": F.ceil(c("y") + 3).cast("int")})
    ray = spark.range(3600).select((c("id") % 60).cast("int").alias("ix"), F.floor(c("id") / 60).cast("int").alias("iy"))
    ray = ray.select("ix", "iy", c("ix").cast("double").alias("ox"), c("iy").cast("double").alias("oy"), F.lit(10.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"))
    out = raster.surfel_hits(s, ray)
    return _round(out.select("point_index", c("ix").cast("long").alias("ix"), c("iy").cast("long").alias("iy"), "depth", "reach"))


@query("r11_over_two", f"WITH f AS (SELECT ix, iy, r, alpha, row_number() OVER (PARTITION BY ix, iy ORDER BY depth, layer, point_index) AS k FROM {V.FRAGMENTS}), p AS (SELECT a.ix, a.iy, a.r, a.alpha, coalesce((SELECT product(1 - b.alpha) FROM f b WHERE b.ix = a.ix AND b.iy = a.iy AND b.k < a.k), 1) AS through FROM f a) SELECT ix, iy, round(sum(r * alpha * through), 6) AS r, round(sum(alpha * through), 6) AS alpha FROM p GROUP BY 1, 2")
def r11(spark, d):
    return _round(raster.blend_over(V.fragments(spark, d)).select("ix", "iy", "r", "alpha"))


@query("r15_debug_modes", f"SELECT point_index, round(1 / (1 + exp(-opacity)), 6) AS by_opacity, round(least(greatest(exp(greatest(scale[1], scale[2], scale[3])), 0), 1), 6) AS by_scale FROM {V.SPLATS}")
def r15(spark, d):
    s = splats.decode(V.splats(spark, d))
    a = splats.debug_colour("opacity", s).select("point_index", c("r").alias("by_opacity"))
    return _round(a.join(splats.debug_colour("scale", s).select("point_index", c("g").alias("by_scale")), "point_index"))


@query("r16_focus_blur", f"SELECT point_index, round(abs(x - 10) / greatest(x, 1e-4) * 0.02 * 500, 6) AS blur FROM {V.Q}")
def r16(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", splats.focus_blur(c("x"), 10.0, 0.02, 500.0).alias("blur")))


@query("r11_splat_alpha", f"SELECT point_index, round(CASE WHEN a >= 1 / 255::double THEN least(a, 0.99) ELSE 0 END, 6) AS a FROM (SELECT point_index, {_U} * exp(-0.5 * (4 * dx * dx - 2 * 0.5 * dx * dy + 2 * dy * dy) / 7.75) AS a FROM (SELECT *, x / 10 - 2.5 AS dx, z / 40 - 1 AS dy FROM {V.Q}))")
def r11_alpha(spark, d):
    a = splats.splat_alpha(_u(), c("x") / 10 - 2.5, c("z") / 40 - 1, F.lit(2.0), F.lit(0.5), F.lit(4.0))
    return _round(V.cloud_q(spark, d).select("point_index", a.alias("a")))


@query("r17_normal_aov", f"SELECT ix, iy, round(sum(b * w) / sum(w), 9) AS nz, round(sum(w), 9) AS w FROM (SELECT *, least(greatest(0.5 * pow(least(1, 8 * alpha) + 0.01, 3) + 128 * pow(least(1, 8 * alpha) + 0.01, 3) * pow(1 - least(greatest((depth - 1) / 9, 0), 1), 4), 0.001), 256) * alpha AS w FROM {V.FRAGMENTS}) GROUP BY 1, 2")
def r17(spark, d):
    f = V.fragments(spark, d).withColumns({"nx": c("r"), "ny": c("g"), "nz": c("b")})
    sums = raster.accumulate(f, near=1.0, far=10.0)
    return _round(sums.select("ix", "iy", (c("nz") / c("w")).alias("nz"), "w"), 9)


@query("a26_diagnostics", f"SELECT layer, count(*) AS points, (SELECT count(DISTINCT (ix, iy)) FROM {V.FRAGMENTS}) AS covered FROM {V.FRAGMENTS} GROUP BY 1")
def a26(spark, d):
    f = V.fragments(spark, d)
    return raster.diagnostics(f, raster.depth_test(f)).select("layer", "points", "covered")


# Joins that had no query of their own


@query("j15_visited_exclusion", "SELECT l_partkey AS point_index, min(l_orderkey) AS taken_by FROM lineitem GROUP BY 1")
def j15(spark, d):
    steps = V.table(spark, d, "lineitem").select(c("l_orderkey").alias("branch_id"), c("l_partkey").alias("point_index"))
    return spatial.first_visits(steps, "branch_id").select("point_index", c("branch_id").alias("taken_by"))


@query("f1_level_edges", f"SELECT point_index FROM {V.Q} WHERE NOT {_inside_sql()}")
def f1_outside(spark, d):
    q = V.cloud_q(spark, d)
    ring = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, "xyz")]) for p in C_SHAPE])
    return q.where(~regions.inside_column(c("x"), c("y"), ring)).select("point_index")
