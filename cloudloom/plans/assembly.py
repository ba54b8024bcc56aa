"""Queries for styles, documents, caches, sources and series that ``queries`` has no SQL for."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import scalar as S
from cloudloom.functions import style
from cloudloom.operators import paths, stats, timeseries
from cloudloom.plans import views as V
from cloudloom.plans.queries import _D2, _STEPS, _SUP, _emitters, _round, _suppliers
from cloudloom.plans.registry import query
from cloudloom.sources import assets, caches, documents, ply

c = F.col


def _styles(spark, d):
    """A style for each part, of which each seventh, fifth, ... has something."""
    k = c("p_partkey")
    every = lambda n: k % n == 0
    pick = lambda n, a, b: F.when(every(n), a).otherwise(b)
    fields = {
        "depth_contribution": pick(2, "none", "alpha_threshold"), "geometry_mode": pick(3, "world_surfels", "screen_sprites"), "sprite_size_mode": pick(2, "world_millimeters", "pixels"),
        "color_mode": pick(5, "scalar_colormap", "source_rgb"), "falloff": pick(4, "soft_disc", "hard_disc"), "stylisation": pick(11, "npr_stylisation", "off"),
        "stylisation_strength": pick(22, 0.0, 0.5), "motion_amount": pick(13, 0.2, 0.0), "motion_speed": F.lit(1.0), "caustics_enabled": every(17), "caustic_intensity": F.lit(0.0),
        "caustic_tint": F.lit(0.3), "caustic_fields": ~every(34), "animated": every(19), "colourise_amount": pick(23, 0.4, 0.0),
        "point_size": style.binding(2.0, mode=pick(29, "field_mapped", "constant")), "surfel_diameter": style.binding(0.01), "opacity": style.binding(pick(7, 0.5, 1.0)),
        "emissive_strength": style.binding(0.0), "xray_strength": style.binding(0.0, mode=pick(31, "field_mapped", "constant"), output_max=0.8),
        "depth_fade": style.binding(0.0), "colormap_position": style.binding(0.5),
    }
    return V.table(spark, d, "part").select("p_partkey", F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in fields.items()]).alias("style"))


_MOVES = "(p_partkey % 11 = 0 AND p_partkey % 22 <> 0) OR p_partkey % 13 = 0 OR (p_partkey % 17 = 0 AND p_partkey % 34 <> 0) OR p_partkey % 19 = 0"
_PLAIN = "p_partkey % 5 <> 0 AND p_partkey % 29 <> 0 AND p_partkey % 31 <> 0"


@query("f18_style_predicates", "SELECT p_partkey, p_partkey % 2 <> 0 AS prepass, p_partkey % 31 = 0 AS xray, p_partkey % 11 = 0 AND p_partkey % 22 <> 0 AS stylised, p_partkey % 13 = 0 AS motion, p_partkey % 17 = 0 AND p_partkey % 34 <> 0 AS caustics, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS world_sized FROM part")
def f18(spark, d):
    s = c("style")
    found = {"prepass": style.uses_prepass(s), "xray": style.has_xray(s), "stylised": style.has_stylisation(s), "motion": style.has_motion(s), "caustics": style.has_caustics(s), "world_sized": style.world_sized(s)}
    return _styles(spark, d).select("p_partkey", *[v.alias(n) for n, v in found.items()])


@query("f19_material", f"SELECT p_partkey, CASE WHEN {_MOVES} OR NOT ({_PLAIN}) THEN 'unified' WHEN p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 23 <> 0 THEN 'opaque_hard_disc' ELSE 'constant_simple' END AS material FROM part")
def f19(spark, d):
    return _styles(spark, d).select("p_partkey", style.material(c("style")).alias("material"))


@query("e9_fast_basic", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'scalar_colormap' WHEN p_partkey % 2 = 0 THEN 'source_rgb' ELSE 'solid_color' END AS color_mode, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 0.01 ELSE 0.005 END::double AS surfel, 1.0::double AS opacity, CASE WHEN p_partkey % 5 <> 0 AND NOT (p_partkey % 17 = 0 AND p_partkey % 34 <> 0) THEN 'opaque_hard_disc' ELSE 'other' END AS material FROM part WHERE p_partkey % 23 <> 0")
def e9(spark, d):
    fast = _styles(spark, d).where("p_partkey % 23 <> 0").select("p_partkey", style.fast_basic(c("style"), c("p_partkey") % 2 == 0).alias("style"))
    m = F.when((style.material(c("style")) == "opaque_hard_disc") & (c("style.color_mode") != "scalar_colormap"), "opaque_hard_disc").otherwise("other")
    return fast.select("p_partkey", "style.color_mode", c("style.surfel_diameter.constant").alias("surfel"), c("style.opacity.constant").alias("opacity"), m.alias("material"))


@query("f9_role_filters", f"SELECT point_index, point_index % 4 = 0 AS particle FROM {V.P} WHERE point_index % 4 = 0 OR point_index % 3 <> 0")
def f9(spark, d):
    k = c("point_index")
    rows = V.cloud_p(spark, d).select("point_index", F.when(k % 4 == 0, 1.0).when(k % 5 == 0, F.lit(None)).otherwise(0.2).alias("particle_role"), F.when(k % 3 == 0, 1.0).otherwise(0.0).alias("path_role"))
    particles = style.of_role(rows, "particle_role").select("point_index", F.lit(True).alias("particle"))
    rest = style.of_role(style.of_role(rows, "particle_role", False), "path_role", False).select("point_index", F.lit(False).alias("particle"))
    return particles.unionByName(rest)


@query("f15_confidence_gate", f"SELECT point_index FROM {V.Q} WHERE point_index % 100 >= 56")
def f15(spark, d):
    return style.confident(V.cloud_q(spark, d).withColumn("confidence", c("point_index") % 100 / 100)).select("point_index")


@query("f16_enabled_emitters", "SELECT s_suppkey AS emitter_id FROM supplier WHERE s_suppkey % 5 <> 2")
def f16(spark, d):
    k = c("emitter_id") % 5
    e = _emitters(spark, d).withColumn("status", F.when(k == 0, F.lit(None)).when(k == 1, "candidate").when(k == 2, "disabled").otherwise("accepted"))
    return style.enabled(e).select("emitter_id")


@query("src29_overlay_cloud", "SELECT p_partkey AS point_index, (p_partkey % 256 + (p_partkey * 3 % 256) * 256 + (p_partkey * 7 % 256) * 65536 + 4278190080)::bigint AS packed, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END::double AS wetness, 1.0::double AS nz FROM part")
def src29(spark, d):
    k = c("point_index")
    rgb = {n: (k * m % 256) / 255.0 for n, m in (("r", 1), ("g", 3), ("b", 7))}
    s = V.cloud_q(spark, d).withColumns(rgb | {"nx": F.lit(None).cast("double"), "ny": F.lit(0.0), "nz": F.lit(None).cast("double"), "wetness": F.when(k % 2 == 0, 0.5)})
    return style.overlay_cloud(s, ["wetness"]).select("point_index", "packed", "wetness", "nz")


# Documents and caches


@query("src18_path_cache_anchors", "SELECT s_suppkey AS source, s_suppkey * 10 AS branch_id, seq, s_suppkey::double AS x, CASE WHEN s_suppkey % 2 = 0 THEN 0.25 ELSE 1 END::double AS confidence, -1::bigint AS source_point_index FROM supplier, (VALUES (0), (1)) t(seq)")
def src18(spark, d):
    """Path-cache documents parsed to tables, written back, and parsed again."""
    k = c("s_suppkey")
    text = F.format_string('{"version": 1, "branches": [{"branch_id": %d, "branch_role": "odd", "anchors": [{"position": [%d, 0, 0]%s}, {"position": [%d, 1, 0]%s}]}]}', k * 10, k, F.when(k % 2 == 0, ', "confidence": 0.25').otherwise(""), k, F.when(k % 2 == 0, ', "confidence": 0.25').otherwise(""))
    docs = V.table(spark, d, "supplier").select(k.alias("source"), text.alias("document"))
    again = caches.path_cache_column(*caches.path_cache_tables(docs, "document"), "source")
    branches, anchors = caches.path_cache_tables(again, "document")
    return anchors.join(branches.where("branch_role = 'main' and parent_id = -1").select("source", "branch_id"), ["source", "branch_id"]).select("source", "branch_id", "seq", "x", "confidence", "source_point_index")


@query("src19_field_cache", f"SELECT point_index, x FROM {V.Q}")
def src19(spark, d):
    """Field nodes saved and loaded; a foreign folder and another version are refused."""
    from cloudloom.operators.tables import written

    q = written(V.cloud_q(spark, d).select("point_index", "x"))
    path = f"{q.inputFiles()[0].rsplit('/', 2)[0]}/field-cache-{spark.sparkContext.applicationId}"
    caches.save_field_cache(q, {"resolution": 0.05}, path)
    nodes, settings, issue = caches.load_field_cache(spark, path)
    assert settings == {"resolution": 0.05} and issue is None and caches.load_field_cache(spark, path + "-none")[2]
    return nodes


@query("d8_render_jobs", "SELECT s_suppkey, greatest(s_suppkey % 3 * 640, 1)::int AS width, 1080 AS height, least(greatest(s_suppkey, 16), greatest(16, greatest(s_suppkey % 3 * 640, 1), 1080))::int AS tile, greatest(s_suppkey % 4 * 12, 1)::int AS fps, 5 AS first_frame, greatest(5, s_suppkey % 50)::int AS last_frame FROM supplier")
def d8(spark, d):
    k = c("s_suppkey").cast("int")
    jobs = V.table(spark, d, "supplier").select("s_suppkey", (k % 3 * 640).alias("width"), F.lit(None).cast("int").alias("height"), k.alias("tile"), (k % 4 * 12).alias("fps"), F.lit(5).alias("first_frame"), (k % 50).alias("last_frame"))
    return caches.render_job_columns(jobs)


@query("d15_path_arrays", "SELECT p_partkey, 'a/b/' || p_partkey || '|c' AS paths FROM part")
def d15(spark, d):
    raw = F.array(F.concat(F.lit("a\\b/"), c("p_partkey").cast("string")), F.lit(None), F.lit(""), F.lit("c"))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(caches.path_array_column(raw), "|").alias("paths"))


@query("st2_shell_words", "SELECT p_partkey, '''' || replace(p_name, '''', '''\\''''') || '''' AS quoted, p_partkey::varchar AS plain FROM part WHERE NOT regexp_full_match(p_name, '[A-Za-z0-9_@%+=:,./-]+') UNION ALL SELECT p_partkey, p_name, p_partkey::varchar FROM part WHERE regexp_full_match(p_name, '[A-Za-z0-9_@%+=:,./-]+')")
def st2(spark, d):
    return V.table(spark, d, "part").select("p_partkey", caches.shell_quoted(c("p_name")).alias("quoted"), caches.shell_quoted(c("p_partkey").cast("string")).alias("plain"))


def _rows(values: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {values}) t({names})"


@query("d1_enum_members", _rows("('colormap', 'nope', 'viridis'), ('renderer', 'raytraced', 'beauty'), ('falloff', 'gaussian', 'gaussian'), ('emitter_status', 'disabled', 'disabled'), ('ripple_type', 'tide_bands', 'shoreline'), ('npr_preset', 'watercolour', 'watercolor')", "kind, value, member"))
def d1_enum(spark, d):
    given = [("colormap", "nope"), ("renderer", "raytraced"), ("falloff", "gaussian"), ("emitter_status", "disabled"), ("ripple_type", "tide_bands"), ("npr_preset", "watercolour")]
    return spark.createDataFrame([(k, v, documents.enum(k, v)) for k, v in given], "kind string, value string, member string")


@query("d2_bindings", _rows("(0, 'constant', 3.0::double, 5, true), (1, 'field_mapped', 1.0, 4, true), (2, 'constant', 1.0, 5, false)", "seq, mode, constant, flags, active"))
def d2(spark, d):
    given = [{"constant": [3.0]}, {"mode": "field_mapped", "flags": 4}, {"mode": "odd", "active": False}]
    out = [documents.binding(b, 1.0) for b in given]
    return spark.createDataFrame([(i, b["mode"], float(b["constant"][0]), b["flags"], b["active"]) for i, b in enumerate(out)], "seq int, mode string, constant double, flags int, active boolean")


@query("d3_styles", _rows("(0, 'viridis', 'off', 'source_rgb', 1.0::double), (1, 'plasma', 'brush_particles', 'solid_color', 4.0), (2, 'viridis', 'npr_stylisation', 'source_rgb', 1.0)", "seq, colormap, stylisation, color_mode, point_size"))
def d3(spark, d):
    """Defaults; both spellings, of which the native one wins."""
    given = [{}, {"colormap": "plasma", "stylization": "brush_particles", "color_mode": "solid_color", "bindings": {"point_size": {"constant": [4.0]}}}, {"stylization": "brush_particles", "stylisation": "npr_stylisation"}]
    out = [documents.style(s) for s in given]
    return spark.createDataFrame([(i, s["colormap"], s["stylisation"], s["color_mode"], float(s["bindings"]["point_size"]["constant"][0])) for i, s in enumerate(out)], "seq int, colormap string, stylisation string, color_mode string, point_size double")


@query("d4_legacy_render_modes", _rows("('solid', 'hard_disc', 'alpha_threshold', false), ('emissive_hard', 'hard_disc', 'none', false), ('emissive_feathered', 'soft_disc', 'none', false), ('xray', 'hard_disc', 'none', true), ('gaussian_sprite', 'gaussian', 'none', false)", "mode, falloff, depth, xray"))
def d4(spark, d):
    modes = ("solid", "emissive_hard", "emissive_feathered", "xray", "gaussian_sprite")
    out = [(m, documents.style({"render_mode": m})) for m in modes]
    return spark.createDataFrame([(m, s["falloff"], s["depth_contribution"], s["xray_enabled"]) for m, s in out], "mode string, falloff string, depth string, xray boolean")


@query("src14_projects", _rows("(0, 'Untitled', 'beauty', 24, 0, 0), (1, 'Site', 'beauty', 24, 2, 1), (2, 'Site', 'fast_basic', 24, 0, 1)", "seq, name, renderer, version, layers, ripples"))
def src14(spark, d):
    """D5j, D6j, D12j: projects of several ages at the current version."""
    given = [{}, {"name": "Site", "renderer": "raytraced", "layers": [{"path": "a.ply"}, {"kind": "gaussian_splat"}], "caustic_regions": [{"id": 1}]}, {"name": "Site", "renderer": "fast_basic", "ripple_layers": [{"id": 3}], "caustic_regions": [{"id": 1}, {"id": 2}]}]
    out = [documents.project(p) for p in given]
    return spark.createDataFrame([(i, p["name"], p["renderer"], p["version"], len(p["layers"]), len(p["ripple_layers"])) for i, p in enumerate(out)], "seq int, name string, renderer string, version int, layers int, ripples int")


@query("d9_emitters", _rows("(0, 'default', NULL, 'accepted'), (1, 'custom', NULL, 'disabled'), (2, 'linked_emitter', 7, 'accepted'), (3, 'default', NULL, 'candidate')", "seq, assignment, link, status"))
def d9(spark, d):
    given = [{}, {"settings": {"length": 2}, "status": "disabled", "linked_emitter_id": 4}, {"assignment": "linked_emitter", "linked_emitter_id": 7}, {"assignment": "odd", "linked_emitter_id": 7, "status": "candidate"}]
    out = [documents.emitter(e) for e in given]
    return spark.createDataFrame([(i, e["assignment"], e["linked_emitter_id"], e["status"]) for i, e in enumerate(out)], "seq int, assignment string, link int, status string")


@query("d11_legacy_looseness", f"SELECT point_index, round(0.45 * least(greatest(x / 20 / 1.5, 0), 1) + 0.35 * 0.4 + 0.20 * least(greatest(z / 60 / 1.5, 0), 1), 9) AS looseness FROM {V.Q}")
def d11(spark, d):
    rows = V.cloud_q(spark, d).select("point_index", "x", "z")
    value = F.pandas_udf(lambda a, b: a.combine(b, lambda x, z: documents.legacy_looseness(x / 20, 0.4, z / 60)), "double", F.PandasUDFType.SCALAR)
    return _round(rows.select("point_index", value("x", "z").alias("looseness")), 9)


@query("d11_clamped_settings", _rows("('trail_count', 20000.0::double), ('trail_length', 0.05), ('speed', 3.0), ('looseness', 1.0)", "setting, value"))
def d11_clamped(spark, d):
    out = documents.clamped({"trail_count": 10**9, "trail_length": -3.0, "speed": 3.0, "looseness": 7.5, "turbulence": float("nan")})
    return spark.createDataFrame([(k, float(v)) for k, v in out.items()], "setting string, value double")


@query("d13_bundle_split", _rows("('source_settings', 'speed', 2.0::double), ('trail_settings', 'looseness', 0.5), ('visual_settings', 'turbulence', 1.5)", "part, setting, value"))
def d13(spark, d):
    doc = {"water_settings": {"bake": {"speed": 2.0}, "bundle": {"looseness": 0.9}, "render": {"turbulence": 1.5}}, "trail_settings": {"looseness": 0.5}}
    return spark.createDataFrame([(p, k, float(v)) for p, own in documents.split_bundle(doc).items() for k, v in own.items()], "part string, setting string, value double")


@query("d7_cameras", _rows("(0, 50.0::double, false, 30), (1, 35.0, true, 12)", "seq, fov, focused, duration"))
def d7(spark, d):
    out = documents.animation({"keys": [{}, {"fov": 35.0, "focus_distance": 2.5, "duration": 12}]})["keys"]
    return spark.createDataFrame([(i, k["fov"], "focus_distance" in k, k["duration"]) for i, k in enumerate(out)], "seq int, fov double, focused boolean, duration int")


@query("e91_fingerprint_keys", "SELECT s_suppkey, sha256('{\"s_nationkey\":' || s_nationkey || ',\"s_name\":\"' || s_name || '\"}') AS fingerprint FROM supplier")
def e91(spark, d):
    return V.table(spark, d, "supplier").select("s_suppkey", documents.fingerprint_column("s_nationkey", "s_name").alias("fingerprint"))


@query("e92_same_bake", _rows("('same', true), ('render_only', true), ('other', false)", "kind, same"))
def e92(spark, d):
    a = {"length": 5, "trail_width": 1}
    pairs = {"same": a, "render_only": a | {"trail_width": 9}, "other": a | {"length": 6}}
    return spark.createDataFrame([(k, documents.same_bake(a, b)) for k, b in pairs.items()], "kind string, same boolean")


# Sources


@query("src1_ply_headers", "SELECT n_nationkey, n_nationkey * 100 AS vertices, CASE WHEN n_nationkey % 2 = 0 THEN 'splat' ELSE 'cloud' END AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 28 ELSE 12 + 4 * (n_nationkey % 3) END::int AS record_bytes, CASE WHEN n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN 'field0' ELSE 'field0,field1' END AS fields FROM nation")
def src1(spark, d):
    """SRC1-SRC4, SRC6: headers of clouds with scalar fields and of splats, parsed and laid out."""
    out = []
    for (k,) in V.table(spark, d, "nation").select("n_nationkey").collect():
        names = ["x", "y", "z", *(["f_dc_0", "opacity", "scale_0", "rot_0"] if k % 2 == 0 else [f"scalar_field{i}" for i in range(k % 3)])]
        text = "ply\nformat binary_little_endian 1.0\ncomment made up\n" + f"element vertex {k * 100}\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
        h = ply.parse_header(text.encode() + b"\0" * 8)
        assert h.offset == len(text)
        out.append((k, h.vertices, "splat" if h.is_splat else "cloud", h.layout().itemsize, ",".join(h.fields)))
    return spark.createDataFrame(out, "n_nationkey int, vertices int, kind string, record_bytes int, fields string")


@query("src24_stems", "SELECT p_partkey, 'd/e' AS dir, 'p' || p_partkey AS stem, '.ply' AS ext FROM part")
def src24(spark, d):
    files = V.table(spark, d, "part").select("p_partkey", F.concat(F.lit("d/e/p"), c("p_partkey").cast("string"), F.lit(".ply")).alias("path"))
    return assets.split_paths(files).select("p_partkey", "dir", "stem", "ext")


# Series and paths

_TURN = f"""(SELECT path_id, seq, x - lag(x, 1, x) OVER w AS ax, y - lag(y, 1, y) OVER w AS ay, z - lag(z, 1, z) OVER w AS az, lead(x, 1, x) OVER w - x AS bx, lead(y, 1, y) OVER w - y AS by_, lead(z, 1, z) OVER w - z AS bz FROM {V.PATHS} WINDOW w AS (PARTITION BY path_id ORDER BY seq))"""


@query(
    "w4_turbulence",
    f"""WITH n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS la, sqrt(bx * bx + by_ * by_ + bz * bz) AS lb FROM {_TURN})
    SELECT path_id, seq, round(greatest(least(greatest(abs(CASE WHEN lb > 1e-6 THEN bz / lb WHEN la > 1e-6 THEN az / la ELSE 0 END), 0), 1), 1.4 * CASE WHEN la > 1e-6 AND lb > 1e-6 THEN least(greatest((1 - (ax * bx + ay * by_ + az * bz) / la / lb) * 0.5, 0), 1) ELSE 0 END), 6) AS turbulence FROM n""",
)
def w4(spark, d):
    return _round(timeseries.turbulence(V.paths(spark, d)).select("path_id", "seq", "turbulence"))


@query(
    "w7_fill_gaps",
    f"""WITH m AS (SELECT path_id, seq, z, sum(step) OVER (PARTITION BY path_id ORDER BY seq) AS d, CASE WHEN event_id % 3 = 0 THEN z + 1 END AS s FROM {_STEPS}),
    g AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN d END IGNORE NULLS) OVER b AS pd, last_value(s IGNORE NULLS) OVER b AS pz, first_value(CASE WHEN s IS NOT NULL THEN d END IGNORE NULLS) OVER f AS nd, first_value(s IGNORE NULLS) OVER f AS nz FROM m
      WINDOW b AS (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY path_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT path_id, seq, round(coalesce(s, pz + (nz - pz) * (d - pd) / greatest(nd - pd, 1e-9), pz, nz, z), 5) AS z, CASE WHEN s IS NOT NULL THEN 1.0 WHEN pz IS NULL OR nz IS NULL THEN 0.9 ELSE 0.92 END::double AS confidence FROM g""",
)
def w7(spark, d):
    p = V.paths(spark, d).withColumns({"surface_z": F.when(c("event_id") % 3 == 0, c("z") + 1), "confidence": F.lit(1.0)})
    return _round(timeseries.fill_gaps(timeseries.path_distances(p)).select("path_id", "seq", "z", "confidence"), 5)


@query("a11_straight_motion", _rows("(12.0::double, 6.0::double, 3.0::double, 4.0::double)", "camera_distance, target_distance, seconds, speed"))
def a11(spark, d):
    """Keys on a line at one speed: the ways are the differences of the ends."""
    keys = [{"knot": k, "x": 4.0 * k, "y": 0.0, "z": 0.0, "tx": 0.0, "ty": 2.0 * k, "tz": 0.0} for k in (0.0, 0.5, 2.0, 3.0)]
    return _round(timeseries.motion_stats(spark, keys), 6)


@query("a8_point_spacing", f"WITH s AS (SELECT *, row_number() OVER (ORDER BY point_index) - 1 AS k FROM {V.FLAT_Q}), t AS (SELECT * FROM {V.FLAT_Q} WHERE point_index % greatest(1, ceil((SELECT count(*) FROM part) / 768))::bigint = 0), n AS (SELECT a.point_index, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d FROM t a JOIN t b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) > 1e-12 GROUP BY 1) SELECT round(list_sort(list(d))[floor(0.35 * (count(*) - 1))::int + 1], 9) AS spacing FROM n")
def a8(spark, d):
    q = V.flat_q(spark, d)
    return _round(spark.createDataFrame([(stats.point_spacing(q, q.count()),)], "spacing double"), 9)


@query("e77_auto_tune", "SELECT s_suppkey, round(least(1, greatest(0.002, s * 1.5)), 9) AS voxel, round(least(5, greatest(least(1, greatest(0.002, s * 1.5)) * 1.5, s * 4.5)), 9) AS bridge, round(least(1, greatest(0.002, s * 0.9)), 9) AS step FROM (SELECT s_suppkey, least(1, greatest(1e-4, s_suppkey / 1000)) AS s FROM supplier)")
def e77(spark, d):
    rows = [(k, paths.tune(paths.Bake(), k / 1000)) for (k,) in V.table(spark, d, "supplier").select("s_suppkey").collect()]
    return _round(spark.createDataFrame([(k, b.voxel, b.bridge, b.spacing) for k, b in rows], "s_suppkey long, voxel double, bridge double, step double"), 9)


@query("e87_catmull_rom", f"SELECT path_id, count(*) AS n, round(sum(x), 7) AS x FROM (SELECT path_id, unnest(CASE WHEN p2 IS NULL THEN [x] ELSE [x, 0.5 * (2 * x + (p2 - p0) / 2 + (2 * p0 - 5 * x + 4 * p2 - p3) / 4 + (3 * x - p0 - 3 * p2 + p3) / 8)] END) AS x FROM (SELECT path_id, seq, x, coalesce(lag(x) OVER w, x) AS p0, lead(x) OVER w AS p2, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS p3 FROM {V.PATHS} WINDOW w AS (PARTITION BY path_id ORDER BY seq))) GROUP BY 1")
def e87(spark, d):
    out = paths.spline_points(V.paths(spark, d), 2)
    return _round(out.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")), 7)


@query("g7_far_emitters", f"SELECT query_id, point_index FROM (SELECT query_id, point_index, {_D2} AS d2 FROM {V.FLAT_Q} p, (SELECT query_id, x + 40 AS x, y, z FROM {_SUP}) q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_index) = 1")
def g7_far(spark, d):
    """Queries far from every point widen their search until they have one."""
    from cloudloom.operators import spatial

    far = _suppliers(spark, d).withColumn("x", c("x") + 40)
    return spatial.nearest(far, V.flat_q(spark, d), 0.02).select("query_id", "point_index")


@query("g14_overlay_particles", "WITH a AS (SELECT *, coalesce((flow_id <> lag(flow_id) OVER w)::int, 0) AS c FROM (SELECT o_custkey % 10 AS layer, o_orderkey AS seq, o_orderkey // 400 AS flow_id FROM orders) WINDOW w AS (PARTITION BY layer ORDER BY seq)), n AS (SELECT *, sum(c) OVER (PARTITION BY layer ORDER BY seq)::bigint AS path_no FROM a), k AS (SELECT layer, path_no, max(seq) - min(seq) AS length FROM n GROUP BY 1, 2 HAVING count(*) >= 2) SELECT layer || '-' || path_no AS path_id, least(greatest(floor(length / 25), 1), 8192)::bigint AS n FROM k")
def g14(spark, d):
    """Groups of a stream of anchors, as paths on a line, with a particle for each 25 metres."""
    k = c("o_orderkey")
    rows = V.table(spark, d, "orders").select((c("o_custkey") % 10).alias("layer"), k.alias("seq"), F.floor(k / 400).alias("flow_id"), F.lit(0).alias("particle_role"), k.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return paths.assemble_overlay(rows, 25.0).groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))


@query("g13_ghosts", f"SELECT point_index, i::int AS ghost, round(i / 4::double, 6) AS trail_age FROM {V.Q}, range(5) r(i)")
def g13(spark, d):
    rows = V.cloud_q(spark, d).select("point_index", F.lit(0.5).alias("phase"))
    return _round(paths.ghosts(rows, 4, 0.2).select("point_index", "ghost", "trail_age"))


@query("g9_straight_knots", f"SELECT path_id, seq, 0.0::double AS knot FROM {V.PATHS}")
def g9(spark, d):
    """A level path that goes straight on is nowhere tangled."""
    p = V.paths(spark, d).withColumns({"x": c("seq") * 10.0, "y": F.lit(0.0), "z": F.lit(0.0)})
    return _round(paths.knot_scores(p, 2.0).select("path_id", "seq", "knot"))


@query("g11_straight_paths", f"SELECT path_id, min(seq) AS seq FROM {V.PATHS} GROUP BY 1 UNION SELECT path_id, max(seq) FROM {V.PATHS} GROUP BY 1")
def g11(spark, d):
    """Of a straight path of 29 anchors at most the ends are left: a shortcut over a horizon costs least."""
    p = V.paths(spark, d).withColumns({"x": c("seq") * 1.0, "y": F.lit(0.0), "z": F.lit(0.0), "knot": F.lit(0.0)})
    return paths.simplify(p, horizon=100_000, allowed=0.05).select("path_id", "seq")


@query("g12_lane_counts", f"SELECT path_id || '/' || lane AS path_id, count(*) AS n, 0.0::double AS off_z FROM {V.PATHS}, range(4) r(lane) GROUP BY 1")
def g12(spark, d):
    """Each lane has the path's points, moved sideways only."""
    p = V.paths(spark, d).select("path_id", "seq", (c("seq") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    out = paths.offset_lanes(p, 4, 2.0)
    return _round(out.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("z")).alias("off_z")))


@query("g15_field_direction", f"SELECT path_id, count(*) AS n, round(0.7 / sqrt(0.58::double), 6) AS dx, round(-0.3 / sqrt(0.58::double), 6) AS dz FROM (SELECT path_id, unnest(range(0, greatest(0, ceil(max(seq) * 10 / 50 - 1e-9))::bigint + 1)) AS k FROM {V.PATHS} GROUP BY path_id HAVING max(seq) > 0) GROUP BY 1")
def g15(spark, d):
    """On level paths along x the field is 0.7 of the way and 0.3 down."""
    p = V.paths(spark, d).withColumns({"x": c("seq") * 10.0, "y": F.lit(0.0), "z": F.lit(0.0)})
    out = paths.field_from_anchors(p, 50.0).where((c("dx") != 0) | (c("dz") != -1))
    return _round(out.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.max("dx").alias("dx"), F.max("dz").alias("dz")))


@query("x7_gap_sessions", "SELECT user_id, sum(new)::bigint AS sessions FROM (SELECT user_id, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) - 1800000000 >= 0)::int, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def x7(spark, d):
    from cloudloom.streaming import sessions

    return sessions.batch_sessions(V.table(spark, d, "events"), "30 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("s4_spatial_cells", f"WITH b AS (SELECT min(x) AS lx, max(x) - min(x) AS ex, min(y) AS ly, max(y) - min(y) AS ey, min(z) AS lz, max(z) - min(z) AS ez FROM {V.Q}) SELECT count(DISTINCT (floor(least((x - lx) / ex, 0.999999999999) * 8), floor(least((y - ly) / ey, 0.999999999999) * 8), floor(least((z - lz) / ez, 0.999999999999) * 8))) AS cells FROM {V.Q}, b")
def s4(spark, d):
    """The cells of the octree at the first depth that has enough of them for 200 points."""
    q = V.cloud_q(spark, d)
    return stats.voxel_representatives(q, stats.bounds(q).first().asDict(), 3).agg(F.count(F.lit(1)).alias("cells"))


@query(
    "e88_particle_positions",
    f"""WITH a AS (SELECT path_id, row_number() OVER w - 1 AS segment, x, coalesce(lag(x) OVER w, x) AS p0, coalesce(lead(x) OVER w, x) AS p2, coalesce(lead(x, 2) OVER w, lead(x) OVER w, x) AS p3, count(*) OVER (PARTITION BY path_id) AS n FROM {V.PATHS} WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    k AS (SELECT path_id, i, greatest(least(floor(i / 8::double * (n - 1)), n - 2), 0)::bigint AS segment, i / 8::double * (n - 1) - greatest(least(floor(i / 8::double * (n - 1)), n - 2), 0) AS t FROM (SELECT DISTINCT path_id, n FROM a), range(9) r(i))
    SELECT path_id, i::int AS particle, round(0.5 * (2 * x + (p2 - p0) * t + (2 * p0 - 5 * x + 4 * p2 - p3) * t * t + (3 * x - p0 - 3 * p2 + p3) * t * t * t), 5) AS x FROM k JOIN a USING (path_id, segment)""",
)
def e88(spark, d):
    p = V.paths(spark, d)
    each = p.select("path_id").distinct().withColumn("particle", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("phase", c("particle") / 8)
    return _round(paths.particle_positions(each, p).select("path_id", "particle", "x"), 5)
