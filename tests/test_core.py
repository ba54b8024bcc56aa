"""The engine against worked examples: scans, statistics, samples, masks, bindings, colours, regions, composition, paths, cameras, pixels, splats."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import color, patterns
from cloudloom.functions import scalar as S
from cloudloom.operators import camera, compose, paths, raster, regions, sampling, spatial, splats, stats, timeseries
from cloudloom.sources import assets, documents, exr, ply


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


# Files


def _ply(header, rows, layout):
    return ("\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *header, "end_header"]) + "\n").encode() + np.array(rows, layout).tobytes()


def _tiny(tmp_path):
    names = ["property float x", "property float y", "property float z", "property uchar red", "property uchar green", "property uchar blue", "property float scalar_Temperature", "property double scalar_Density"]
    layout = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("t", "<f4"), ("d", "<f8")]
    rows = [(0, 1, 2, 255, 10, 20, 1.5, 10), (-1, 0.5, 4, 12, 34, 56, 2.5, 20), (3, -2, 1, 90, 120, 150, -4, 5)]
    path = tmp_path / "tiny.ply"
    path.write_bytes(_ply(names, rows, layout))
    return str(path)


def test_cloud_scan_and_statistics(spark, tmp_path):
    path = _tiny(tmp_path)
    for split in (1, 1 << 20):
        df = ply.read_ply(spark, path, split=split)
        assert df.columns == ["point_index", "x", "y", "z", "red", "green", "blue", "Temperature", "Density"]
        assert sorted(values(df, "point_index", "x", "red", "Temperature")) == [(0, 0.0, 255, 1.5), (1, -1.0, 12, 2.5), (2, 3.0, 90, -4.0)]
    assert values(stats.field_stats(df, ["Temperature", "Density"]), "field", "min", "max", "count") == [("Temperature", -4.0, 2.5, 3), ("Density", 5.0, 20.0, 3)]
    box = stats.bounds(df).first()
    assert (box["min_x"], box["min_y"], box["max_z"], box["valid"]) == (-1.0, -2.0, 4.0, True)
    assert values(stats.cloud_focus(df, 3), "x", "y", "z") == [(0.0, 1.0, 2.0)]
    assert stats.bounds(df.limit(0)).first()["valid"] is False


def test_header_rules():
    h = ply.parse_header(b"\nply\nformat ascii 1.0\ncomment made by hand\nelement vertex 2\nproperty float x\nproperty list uchar int f\nend_header\nxx")
    assert (h.format, h.vertices, h.comments) == ("ascii", 2, ["made by hand"])
    with pytest.raises(ply.PlyError):
        h.layout()
    with pytest.raises(ply.PlyError):
        ply.parse_header(b"plyx\nend_header\n")
    with pytest.raises(ply.PlyError):
        ply.parse_header(b"ply\nformat ascii 1.0\n")


@pytest.mark.parametrize("names", [("normal_x", "normal_y", "normal_z"), ("nx", "ny", "nz")])
def test_normals(spark, tmp_path, names):
    path = tmp_path / "n.ply"
    header = [f"property float {n}" for n in ("x", "y", "z", *names)]
    path.write_bytes(_ply(header, [(0, 0, 0, 0, 0, 2), (0, 0, 0, 0, 0, 0), (0, 0, 0, 3, 4, 0)], [(n, "<f4") for n in ("x", "y", "z", *names)]))
    got = np.array(sorted(values(ply.read_ply(spark, str(path)), "point_index", "nx", "ny", "nz")))[:, 1:]
    assert np.allclose(got, [(0, 0, 1), (0, 0, 0), (0.6, 0.8, 0)])


def test_splats_and_transform(spark, tmp_path):
    names = ["x", "y", "z", *[f"f_dc_{i}" for i in range(3)], *[f"f_rest_{i}" for i in range(45)], "opacity", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)]]
    at = [(1, 2, 3), (-1, 0, 1), (0, 1, 2)]
    rest = [(0, *np.log([2, 3, 4]), 2, 0, 0, 0), (2, *np.log([1, 0.5, 2]), 0, 1, 0, 0), (-2, *np.log([1.5, 1, 0.75]), 0, 0, 1, 0)]
    rows = [(*p, *[0.1 * (k + 1) for k in range(48)], *r) for p, r in zip(at, rest)]
    path = tmp_path / "s.ply"
    path.write_bytes(_ply([f"property float {n}" for n in names], rows, [(n, "<f4") for n in names]))
    raw = ply.read_ply(spark, str(path))
    got = splats.to_world(splats.decode(raw), [2, 0, 0, 10, 0, 3, 0, -5, 0, 0, 4, 2, 0, 0, 0, 1]).orderBy("point_index").collect()
    assert [round(r["opacity"], 6) for r in got] == [0.5, round(1 / (1 + math.exp(-2)), 6), round(1 / (1 + math.exp(2)), 6)]
    assert np.allclose(got[0]["scale"], (2, 3, 4), rtol=1e-6) and got[0]["rot"] == [1, 0, 0, 0]
    assert np.allclose(got[0]["sh"][:6], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    assert [(r["x"], r["y"], r["z"]) for r in got] == [(12, 1, 14), (8, -5, 6), (10, -2, 10)]
    assert values(stats.splat_focus(raw), "x", "y", "z") == [(0.0, 1.0, 2.0)]


def test_ply_round_trip(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("point_index"), (F.col("id") * 0.5).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), (F.col("id") % 7).alias("k"))
    path = str(tmp_path / "out.ply")
    assert ply.write_ply(df.repartition(5), path, ["k"]) == 1000
    back = ply.read_ply(spark, path, split=999)
    assert values(back.agg(F.sum("x"), F.sum("k"), F.count("*")), "*") == [(249750.0, float(sum(i % 7 for i in range(1000))), 1000)]
    with pytest.raises(ply.PlyError):
        ply.write_ply(df.limit(0), path, [])
    with open(path, "r+b") as f:
        f.truncate(200)
    with pytest.raises(Exception, match="shorter"):
        ply.read_ply(spark, path).count()


def test_discovery_and_transforms(spark, tmp_path):
    _tiny(tmp_path)
    (tmp_path / "gSplat-a.ply").write_bytes(b"ply\n")
    (tmp_path / "GSPLAT-A.txt").write_text("1 0 0 5\n0 1 0 0\n0 0 1 0\n0 0 0 1\n")
    (tmp_path / "note.md").write_text("x")
    files = assets.classify(assets.list_files(spark, str(tmp_path)), assets.look_at_header)
    assert sorted(values(files, "name", "kind"), key=str) == [("GSPLAT-A.txt", None), ("gSplat-a.ply", "splat"), ("note.md", None), ("tiny.ply", "cloud")]
    texts = spark.read.text(str(tmp_path / "*.txt"), wholetext=True).select(F.lit(values(files.where("name = 'GSPLAT-A.txt'"), "path")[0][0]).alias("path"), F.col("value").alias("text"))
    matrices = assets.split_paths(assets.read_matrices(texts)).select("dir", "stem", "path", "matrix")
    found = {k: (m, i) for k, m, i in values(assets.catalogue(files, matrices), "kind", "matrix", "issue")}
    assert found["cloud"] == (None, None) and found["splat"][0][3] == 5 and found["splat"][1] is None
    assert assets.list_files(spark, str(tmp_path / "missing")).count() == 0


def test_exr_layout():
    data = exr.encode(3, 2, np.ones((2, 3, 3)) * -1, np.full((2, 3), 2.0), np.full((2, 3), np.inf))
    assert struct.unpack_from("<i", data)[0] == 20000630
    first = struct.unpack_from("<Q", data, data.index(b"screenWindowWidth") + len("screenWindowWidth\0float\0") + 8 + 1)[0]
    y, size = struct.unpack_from("<ii", data, first)
    assert (y, size) == (0, 3 * (2 * 4 + 4))
    assert np.frombuffer(data, "<f2", 3, first + 8).tolist() == [1, 1, 1]  # alpha, clamped
    with pytest.raises(ValueError):
        exr.encode(3, 2, np.ones((2, 3, 3)), np.ones((2, 2)), np.ones((2, 3)))


# Samples and masks


def test_coprime_sample(spark):
    assert sampling.coprime_step(100) == 51
    got = sorted(values(sampling.coprime_sample(spark, 100, 10), "point_index"))
    assert [g[0] for g in got] == [36, 38, 40, 42, 44, 85, 87, 89, 91, 93]
    assert sampling.coprime_sample(spark, 8, 8) is None and sampling.coprime_sample(spark, 8, 3).count() == 3
    assert [sampling.clamp_budget(*a) for a in ((0, 5), (9, 0), (9, 5), (9, 99))] == [0, 1, 5, 9]


def test_surfel_corners(spark):
    got = values(sampling.surfel_corners(spark.createDataFrame([(2,), (7,)], "point_index long")), "corner")
    assert sorted(g[0] for g in got) == [*range(12, 18), *range(42, 48)]


def test_spatial_sample_covers(spark):
    pts = [(i, cx + 0.1 * k, cy + 0.1 * k, 0.0) for i, (cx, cy, k) in enumerate((a, b, k) for a in (0.0, 100.0) for b in (0.0, 100.0) for k in range(6))]
    df = spark.createDataFrame(pts, "point_index long, x double, y double, z double")
    got = sampling.spatial_sample(df, 4).join(df, "point_index").collect()
    assert {(r["x"] > 50, r["y"] > 50) for r in got} == {(a, b) for a in (False, True) for b in (False, True)} and len(got) == 4


def test_stratified_on_a_grid(spark):
    df = spark.range(102 * 102).select(F.col("id").alias("point_index"), (F.col("id") % 102).cast("double").alias("x"), F.floor(F.col("id") / 102).cast("double").alias("y"), F.lit(0.0).alias("z"))
    got = [r[0] for r in values(sampling.spatial_sample(df, 10_000), "point_index")]
    assert len(got) == len(set(got)) == 10_000 and sorted(got) != list(range(10_000))


def test_frustum_union(spark):
    df = spark.createDataFrame([(0, -4.0, 0.0, 0.0), (1, -0.25, 0.0, 0.0), (2, 0.25, 0.0, 0.0), (3, 4.0, 0.0, 0.0), (4, 0.0, 2.5, 0.0)], "point_index long, x double, y double, z double")
    ids = lambda views: {r[0] for r in values(sampling.frustum_union(df, views, 32)[0], "point_index")}
    assert ids([camera.orthographic(0, 0, 0.5)]) == {1, 2}
    both = ids([camera.orthographic(-4, 0, 0.5), camera.orthographic(4, 0, 0.5)])
    assert {0, 3} <= both and not both & {1, 2}
    assert sampling.frustum_union(df, [camera.orthographic(0, 0, 100)], 8)[1] is False


def test_large_median(spark):
    df = spark.range(50_001).select((F.hash("id") % 977).cast("double").alias("v"))
    want = sorted(r[0] for r in df.collect())[50_001 // 2]
    assert stats.upper_median_of(df, "v", bins=16, few=100) == want
    assert stats.upper_median_of(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "v double"), "v") == 2.0
    assert stats.upper_median_of(df.limit(0), "v") is None


def test_convex_hull_and_greedy():
    assert sampling.convex_hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5), (0, 0)]) == [(0, 0), (1, 0), (1, 1), (0, 1)]
    got = sampling.greedy_spaced([(1.0, 0, 0, 0), (0.9, 0.1, 0, 0), (0.8, 2, 0, 0), (0.7, 4, 0, 0)], 0.5, 2)
    assert [g[0] for g in got] == [1.0, 0.8]


# Bindings and colours


def test_bindings(spark):
    st = S.Stats(0.0, 10.0)
    b = S.configure(S.Binding(), "v", st)
    from dataclasses import replace

    squared = replace(b, gamma=2.0)
    got = one(
        spark,
        S.evaluate(S.Binding(constant=2.5)),
        S.evaluate(squared, F.lit(5.0), st),
        S.evaluate(replace(squared, flags=5 | S.INVERT), F.lit(2.5), st),
        S.evaluate(replace(b, flags=S.LAYER_STATS, out_lo=-1.0), F.lit(15.0), st),
        S.with_default(replace(b, active=False), "opacity"),
    )
    assert list(got) == [2.5, 0.25, 0.5625, 2.0, 1.0]
    assert S.resolve_field(["a", "b"], 1, "z") == "b" and S.resolve_field(["a"], 3, "a") == "a" and S.resolve_field(["a"], -1, "q") is None


def test_colormaps(spark):
    listed = [("topographic", 0.0, (0.03, 0.12, 0.28)), ("topographic", 1.0, (0.96, 0.95, 0.90)), ("land_surface", 1.0, (0.86, 0.82, 0.72)), ("exponential_fire", 0.0, (0, 0, 0)), ("exponential_fire", 1.0, (1, 1, 0.92)), ("exponential_ice", 1.0, (0.96, 1, 1)), ("high_contrast", 0.5, (0, 0.82, 0.95))]
    for name, t, want in listed:
        assert np.allclose(one(spark, *color.colormap(name, F.lit(t))), want, atol=1 / 255)
    assert np.allclose(one(spark, *color.gradient((1, 0, 0), (0, 0, 1), F.lit(0.25))), (0.75, 0, 0.25))
    # published values of the perceptual maps, to a 255th
    near = [("viridis", 0, (0.267004, 0.004874, 0.329415)), ("viridis", 128, (0.127568, 0.566949, 0.550556)), ("viridis", 255, (0.993248, 0.906157, 0.143936)), ("plasma", 0, (0.050383, 0.029803, 0.527975))]
    near += [("inferno", 128, (0.735683, 0.215906, 0.330245)), ("magma", 128, (0.716387, 0.214982, 0.475290)), ("cividis", 255, (0.995737, 0.909344, 0.217772)), ("turbo", 128, (0.643620, 0.989990, 0.233560))]
    for name, i, want in near:
        assert np.allclose(one(spark, *color.colormap(name, F.lit(i / 255))), want, atol=1 / 255), name


def test_hsl_and_bytes(spark):
    for rgb in [(1.0, 0.2, 0.4), (0.1, 0.9, 0.3), (0.5, 0.5, 0.5), (0.0, 0.0, 1.0)]:
        back = color.hsl_to_rgb(color.rgb_to_hsl(tuple(F.lit(c) for c in rgb)))
        assert np.allclose(one(spark, *back), rgb, atol=1e-9)
    assert list(one(spark, *[S.to_byte(S.linear_to_srgb(F.lit(v))) for v in (1.0, 0.5, 0.0)])) == [255, 188, 0]
    assert list(one(spark, S.to_byte(F.lit(float("nan"))), S.to_byte(F.lit(float("inf"))))) == [0, 0]
    packed = color.pack_rgb(F.lit(300), F.lit(34.9), F.lit(-1))
    assert np.allclose(one(spark, *color.unpack_rgb(packed)), (1, 34 / 255, 0))


def test_hash_matches_plain_arithmetic(spark):
    def plain(x):
        x &= 0xFFFFFFFF
        x ^= x >> 16
        x = x * 0x7FEB352D & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x846CA68B & 0xFFFFFFFF
        return x ^ x >> 16

    xs = [0, 1, 77, 2**31, 2**32 - 1, 123456789]
    got = values(spark.createDataFrame([(x,) for x in xs], "x long"), S.hash32(F.col("x")))
    assert [g[0] for g in got] == [plain(x) for x in xs]


# Regions and fields


def grid(spark, n, extra=True):
    df = spark.range(n * n).select(F.col("id").alias("point_index"), (F.col("id") % n / (n - 1)).alias("x"), (F.floor(F.col("id") / n) / (n - 1)).alias("y"), F.lit(0.0).alias("z"))
    return df.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "roughness": F.col("x") + F.col("y")}) if extra else df


C = [(0, 0, 0), (1, 0, 0), (1, 0.25, 0), (0.25, 0.25, 0), (0.25, 0.75, 0), (1, 0.75, 0), (1, 1, 0), (0, 1, 0)]


def test_concave_region(spark):
    got = {(r["x"], r["y"]): r for r in regions.select_region(grid(spark, 17), C, blend=0.05).collect()}
    r = got[0.125, 0.5]
    assert r["roughness"] == 0.625 and r["fx"] > 0.9 and (0.75, 0.5) not in got
    assert r["edge_weight"] == 1.0 and r["wetness"] == 1.0
    assert regions.select_region(grid(spark, 5), C[:2]).count() == 0


def test_polygon_columns_agree(spark):
    rows = spark.createDataFrame([(1, [dict(x=float(a), y=float(b), z=float(c)) for a, b, c in [*C, C[-1], C[0]]])], "k int, vertices array<struct<x:double,y:double,z:double>>")
    both = grid(spark, 17).join(rows.withColumn("b", regions.boundary_column(F.col("vertices"))))
    counts = both.agg(F.sum((regions.inside_column(F.col("x"), F.col("y"), F.col("b")) != regions.inside(F.col("x"), F.col("y"), C)).cast("int")), F.min(F.size("b"))).first()
    assert list(counts) == [0, 8]


def test_no_flow_blocks_a_node(spark):
    pts = grid(spark, 17)
    blocked = regions.select_region(pts, [(0, 0.375, 0), (0.25, 0.375, 0), (0.25, 0.625, 0), (0, 0.625, 0)], feature="no_flow")
    nodes = {(r["x"], r["y"]): r for r in paths.field_from_regions(pts, C, blocked, blend=0.05).collect()}
    assert nodes[0.125, 0.5]["flow_blocked"] and nodes[0.125, 0.5]["wetness"] == 0
    assert not nodes[0.125, 0.125]["flow_blocked"] and min(r["station"] for r in nodes.values()) == 0


def test_gap_split(spark):
    rows = [(0, i, x, 0.0, 0.0, c, False, False, False) for i, (x, c) in enumerate([(0.0, 1.0), (0.10, 1.0), (1.00, 0.25), (1.05, 0.25)])]
    df = spark.createDataFrame(rows, "path_id int, seq int, x double, y double, z double, confidence double, flow_blocked boolean, bridge_allowed boolean, bridge_blocked boolean")
    got = timeseries.gap_islands(df, resolution=0.05, max_bridge=0.12, aggression=0.0, threshold=0.5).orderBy("seq").collect()
    assert [r["island"] for r in got] == [1, 1, 2, 2] and got[0]["fade"] == 1 and got[2]["fade"] < 0.999
    d = timeseries.gap_diagnostics(df, resolution=0.05, max_bridge=0.12).first()
    assert d["rejected_gaps"] == 1 and d["min_rejected"] == pytest.approx(0.9) and d["accepted_bridges"] == 1


# Composition


def _effect(i, order, mode, **k):
    base = dict(value=0.5, emission=0.0, opacity=0.0, size=0.0, opacity_mul=1.0, size_mul=1.0, mix=0.0, red=0.0, green=0.0, blue=0.0)
    return {"point_index": i, "order": order, "mode": mode, **base, **k}


SCHEMA = "point_index long, order int, mode string, value double, emission double, opacity double, size double, opacity_mul double, size_mul double, mix double, red double, green double, blue double"


def fold(effects):
    """A plain version of the ordered fold, one point."""
    s = dict(value=0.0, emission=0.0, opacity=0.0, size=0.0, opacity_mul=1.0, size_mul=1.0, mix=0.0, red=0.0, green=0.0, blue=0.0)
    sums, weight = dict(red=0.0, green=0.0, blue=0.0), 0.0
    c1 = lambda x: min(1.0, max(0.0, x))
    scr = lambda a, b: 1 - (1 - c1(a)) * (1 - c1(b))
    for e in sorted(effects, key=lambda e: e["order"]):
        m = e["mode"]
        if e["value"] <= 1e-6:
            continue
        s["value"] = {"add": c1(s["value"] + e["value"]), "screen": scr(s["value"], e["value"]), "override": e["value"]}.get(m, max(s["value"], e["value"]))
        for k in ("emission", "opacity", "size"):
            s[k] = {"max": max(s[k], e[k]), "screen": scr(s[k], e[k]), "override": e[k]}.get(m, s[k] + e[k])
        for k in ("opacity_mul", "size_mul"):
            s[k] = {"max": max(s[k], e[k]), "override": e[k]}.get(m, s[k] * e[k])
        if m == "override" or (m == "max" and e["mix"] >= s["mix"]):
            s |= {k: e[k] for k in ("red", "green", "blue")}
        s["mix"] = {"max": max(s["mix"], e["mix"]), "screen": scr(s["mix"], e["mix"]), "override": e["mix"]}.get(m, c1(s["mix"] + e["mix"]))
        if m == "override":
            weight = 0.0
        elif m != "max" and e["mix"] > 1e-6:
            sums = {k: v + e[k] * e["mix"] for k, v in sums.items()}
            weight += e["mix"]
    return s | ({k: v / weight for k, v in sums.items()} if weight > 1e-6 else {})


def test_ordered_fold(spark):
    import random

    rng = random.Random(4)
    rows = [_effect(i, o, rng.choice(compose.MODES), **{k: rng.random() for k in ("value", "emission", "opacity", "size", "opacity_mul", "size_mul", "mix", "red", "green", "blue")}) for i in range(60) for o in range(rng.randint(1, 6))]
    rows.append(_effect(99, 0, "add", value=0.0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["point_index"]: r.asDict() for r in compose.compose(df).collect()}
    assert set(got) == set(range(60))
    for i in range(60):
        want = fold([r for r in rows if r["point_index"] == i])
        assert {k: got[i][k] for k in want} == pytest.approx(want)
    for mode in ("add", "max", "screen"):
        same = df.withColumn("mode", F.lit(mode))
        full = {r["point_index"]: r for r in compose.compose(same).collect()}
        for r in compose.compose_uniform(same, mode).collect():
            assert all(full[r["point_index"]][c] == pytest.approx(r[c]) for c in ("value", "emission", "opacity", "size"))


# Paths and cameras


def test_frames(spark):
    seg = spark.createDataFrame([(0, 0, 3), (0, 1, 3)], "path_id int, seq int, frames long")
    assert timeseries.expand_frames(seg.where("seq = 0")).count() == 4 and timeseries.expand_frames(seg).count() == 7
    assert timeseries.slice_frames(timeseries.expand_frames(seg), 1, 2).count() == 2
    assert timeseries.still_frames(spark.range(1), 2.5, 24).count() == 60
    assert list(one(spark, S.frame_path(F.lit(41)), S.rescale_frames(F.lit(60), 60), S.rescale_frames(F.lit(60), 30))) == ["frame_000042.exr", 120, 60]
    sizes = [(1920, 1080, 1), (3840, 2160, 2), (960, 540, 0.5), (3840, 1080, math.sqrt(2)), (0, 0, 1)]
    assert [one(spark, S.point_size_scale(F.lit(w), F.lit(h)))[0] for w, h, _ in sizes] == pytest.approx([s for *_, s in sizes])


def test_splines_and_slerp(spark):
    keys = [{"knot": 0.0, "x": 0.0}, {"knot": 1.0, "x": 1.0}, {"knot": 2.0, "x": 0.0}]
    t = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (9.0,)], "t double")
    got = [r[0] for r in values(timeseries.evaluate_path(t, keys, ["x"]), "x")]
    assert got == pytest.approx([0, 0.6875, 1, 0, 0])
    h = math.sqrt(0.5)
    z, w = one(spark, *timeseries.slerp([F.lit(0.0)] * 3 + [F.lit(1.0)], [F.lit(0.0), F.lit(0.0), F.lit(-h), F.lit(-h)], F.lit(0.5))[2:])
    assert (z, w) == pytest.approx((math.sin(math.radians(22.5)), math.cos(math.radians(22.5))))


def test_apportion_edges(spark):
    df = spark.createDataFrame([(0, i, w) for i, w in enumerate([1.0, 1.0, 2.0])] + [(1, i, 0.0) for i in range(3)], "path_id int, seq int, weight double")
    got = timeseries.apportion(df, 8).orderBy("path_id", "seq").collect()
    assert [r["frames"] for r in got] == [2, 2, 4, 3, 3, 2]
    assert [r["frames"] for r in timeseries.apportion(df, 1).collect()] == [1] * 6


def test_downhill_line(spark):
    pts = [(i, 0.0, i * 0.03, 1 - 0.04 * i, 1.0, 0.0, 0.0) for i in range(24)]
    df = spark.createDataFrame(pts, "point_index long, x double, y double, z double, nx double, ny double, nz double")
    bake = paths.Bake(voxel=0.02, bridge=0.09, radius=0.09, length=0.7, steps=48)
    support = paths.support_graph(df, 24, bake)
    out = paths.trace(spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "emitter_id long, x double, y double, z double"), support, bake)
    main = [r for r in out.orderBy("branch_id", "seq").collect() if r["branch_id"] == 0]
    assert main[0]["point_index"] == 0 and all(b["point_index"] > a["point_index"] for a, b in zip(main, main[1:]))
    assert main[-1]["path_distance"] >= 0.7 and main[0]["stop"] == "reached_length"
    assert all(b["confidence"] <= a["confidence"] or a["seq"] == 0 for a, b in zip(main, main[1:]))
    assert out.exceptAll(paths.trace(spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "emitter_id long, x double, y double, z double"), support, bake)).count() == 0


def test_resample_and_simplify(spark):
    df = spark.createDataFrame([("p", i, float(i), 0.0, 0.0) for i in range(11)], "path_id string, seq long, x double, y double, z double")
    got = [r[0] for r in values(paths.resample(df, 2.5).orderBy("seq"), "x")]
    assert got == pytest.approx([0, 2.5, 5, 7.5, 10])
    bent = np.array([(i, 0.0, 0.0) for i in range(10)] + [(9.0, i, 0.0) for i in range(1, 10)])
    assert paths.simplify_path(bent, np.zeros(19), 28, 0.05) == [0, 9, 18]
    assert [r[0] for r in values(paths.simplify(df.withColumn("knot", F.lit(0.0))).orderBy("seq"), "seq")] == [0, 10]


def test_field_walk_follows_the_line(spark):
    n = spark.range(20).select(F.col("id").alias("point_index"), (F.col("id") * 0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(1.0).alias("confidence"))
    walk = paths.field_walks(n, spark.createDataFrame([(5, 0)], "seed_id long, point_index long"), 0.15, 8)
    assert [r[0] for r in values(walk.orderBy("seq"), "point_index")] == list(range(8))


def test_camera():
    c = camera.Camera((0, -5, 0), (0, 0, 0))
    p = np.array(camera.view_projection(c, 100, 100)).reshape(4, 4) @ [0, 0, 0, 1]
    assert p[:2] / p[3] == pytest.approx([0, 0]) and p[3] == pytest.approx(5)
    q = camera.look_at_quaternion(c)
    assert np.allclose(camera.axes(camera.Camera(c.position, orientation=q)), camera.axes(c), atol=1e-9)
    assert np.linalg.norm(camera.dolly(c, 1).position) == pytest.approx(5 * math.exp(-0.075))
    assert np.linalg.norm(camera.orbit(c, 90, 0).position) == pytest.approx(5)
    assert camera.pan(c, 1, 0).target == pytest.approx((1, 0, 0))
    assert camera.frame(c, (-1, -1, -1), (1, 1, 1)).target == (0, 0, 0)


# Pixels


def test_eye_dome(spark):
    def shade(depths, at, **k):
        rows = [(x, y, d) for y, line in enumerate(depths) for x, d in enumerate(line) if d]
        df = spark.createDataFrame(rows, "ix int, iy int, depth double")
        return {(r["ix"], r["iy"]): r["shade"] for r in raster.eye_dome(df, **k).collect()}.get(at)

    flat, hole = [[4.0] * 3] * 3, [[8.0] * 3, [8.0, 2.0, 8.0], [8.0] * 3]
    assert shade(flat, (1, 1)) == 1 and 0.35 <= shade(hole, (1, 1)) < 1
    assert shade(hole, (1, 1), thickness=0.5) > shade(hole, (1, 1), thickness=1.0, strength=1.0) or shade(hole, (1, 1)) == 0.35
    line = [[2.0, 2.0, 8.0, 2.0, 2.0]]
    assert shade(line, (0, 0), thickness=1.0) == 1 and shade(line, (0, 0), thickness=2.0) < 1


def test_sparse_fill_and_downsample(spark):
    px = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 1.0, 2.0), (1, 0, 0.0, 0.0, 0.0, 0.0, None), (2, 0, 1.0, 0.0, 0.0, 1.0, 2.0)], "ix int, iy int, r double, g double, b double, alpha double, depth double")
    got = {r["ix"]: r for r in raster.fill_sparse(px).collect()}
    assert got[1]["r"] == 1 and got[1]["alpha"] == 0 and got[0]["r"] == 1
    third = {r["ix"]: r["alpha"] for r in raster.downsample(px, 3, 1, 2, 1).collect()}
    assert third == {0: 0.5, 1: 0.5}  # the middle pixel counts in both


def test_render_does_not_depend_on_tiles(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0), (1, -0.2, 0.0, 0.0, 0.0, 1.0, 0.0, 0), (2, 0.2, 0.0, 0.0, 0.0, 0.0, 1.0, 0)], "point_index long, x double, y double, z double, r double, g double, b double, layer int")
    vp = camera.view_projection(camera.Camera((0, -5, 2)), 16, 16)
    whole = raster.render(pts, vp, 16, 16, radius=1.5)
    parts = [whole.where(F.col("ix").between(x, x + w - 1) & F.col("iy").between(y, y + h - 1)) for x, y, w, h in raster.tiles(16, 16, 5)]
    assert sum(p.count() for p in parts) == whole.count() > 3
    assert raster.full_image(whole, 16, 16).count() == 256
    assert raster.render(pts, vp, 16, 16, radius=1.5, mode="fast").count() == whole.count()


def test_splat_order(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 5.0), (2, 6.0), (3, 7.0)], "merged_index long, view_depth double")
    assert [r[0] for r in values(sampling.back_to_front(df).orderBy("draw"), "merged_index")] == [3, 2, 1, 0]
    same = df.withColumn("view_depth", F.lit(1.0))
    assert [r[0] for r in values(sampling.back_to_front(same).orderBy("draw"), "merged_index")] == [0, 1, 2, 3]


def test_blend_over_equals_the_fold(spark):
    rows = [(0, 0, i, 0, i, 0.1 * i, 0.5, 0.2, 0.1 + 0.2 * i) for i in range(4)]
    df = spark.createDataFrame([(a, b, float(c), d, e, f, g, h, i) for a, b, c, d, e, f, g, h, i in rows], "ix int, iy int, depth double, layer int, point_index int, r double, g double, b double, alpha double")
    r, through = 0.0, 1.0
    for _, _, _, _, _, red, _, _, a in rows:
        r, through = r + red * a * through, through * (1 - a)
    got = raster.blend_over(df).first()
    assert (got["r"], got["alpha"]) == pytest.approx((r, 1 - through))


def test_patterns(spark):
    u, v = np.meshgrid(np.linspace(0, 1, 41), np.linspace(0, 1, 41))
    for kind, p in patterns.DEFAULTS.items():
        a, b = (patterns.evaluate(p, u.ravel(), v.ravel(), t, 77) for t in (0.0, 0.0))
        assert (a == b).all() and a.min() >= 0 and a.max() <= 1 and a.std() > 0.01, kind
        assert (a != patterns.evaluate(p, u.ravel(), v.ravel(), 0.37, 77)).any(), kind
        column = values(spark.createDataFrame([(0.3, 0.4)], "u double, v double"), patterns.pattern_column(p, F.col("u"), F.col("v"), 0.0, 77))
        assert column[0][0] == pytest.approx(patterns.evaluate(p, [0.3], [0.4], 0.0, 77)[0])
    assert np.allclose(patterns.catmull_rom(0, 1, 2, 3, np.array([0, 0.5, 1])), [1, 1.5, 2])
    lanes = patterns.lane_offset(np.linspace(0, 1, 50), np.full(50, 3), 5, 2.0, 0.3)
    assert np.abs(lanes).max() <= 1
    assert np.abs(patterns.roughness_offset(u.ravel(), v.ravel(), 1.0, 0.2, 1.0)).max() <= 0.2
    for mode in ("cartoon", "watercolour", "brush", "hatch", "off"):
        assert patterns.stylise(np.full((9, 3), 0.4), np.arange(9), np.arange(9), mode).shape == (9, 3)


# Documents


def test_documents_round_trip(tmp_path):
    doc = documents.project({"name": "P", "renderer": "raytraced", "layers": [{"path": "a.ply", "style": {"render_mode": "xray", "stylization": "brush_particles"}}], "emitters": [{"id": 1, "settings": {"speed": 1}, "linked_emitter_id": 4}], "caustic_regions": [{"vertices": [[0, 0, 0], [1, 0, 0], [1, 1, 0]], "settings": {"scale": 2.0}}], "water_settings": {"bake": {"resolution": 0.0}, "render": {"speed": 99}}})
    assert (doc["renderer"], doc["version"]) == ("beauty", 24)
    assert doc["layers"][0]["style"]["xray_enabled"] and doc["layers"][0]["style"]["stylisation"] == "brush_particles"
    assert doc["emitters"][0]["assignment"] == "custom" and doc["emitters"][0]["linked_emitter_id"] is None
    assert doc["ripple_layers"][0]["pattern_settings"]["caustic_lace"]["scale"] == 0.5 and len(doc["ripple_layers"][0]["hull"]) == 3
    assert doc["source_settings"]["resolution"] == 0.005 and doc["visual_settings"]["speed"] == 20.0
    path = str(tmp_path / "deep" / "p.json")
    documents.save(doc, path)
    again, error = documents.load(path, "project")
    assert error is None and again == doc
    assert documents.loads("{", "project")[0] is None and documents.load(path + "x", "style")[1]
    assert documents.ripple_layer({"ripple_type": "tide_bands"})["ripple_type"] == "shoreline"
    assert documents.legacy_looseness(1.5, 1.0, 1.5) == pytest.approx(1.0)
    assert documents.legacy_caustic({"scale": 1.0, "sharpness": 1.0})["line"] == pytest.approx(0.025)
    assert documents.same_bake({"a": 1, "smoothing": 2}, {"a": 1, "smoothing": 3}) and not documents.same_bake({"a": 1}, {"a": 2})
    assert documents.fingerprint({"a": 1, "b": 2}) == documents.fingerprint({"b": 2, "a": 1})


def test_camera_import():
    keys, error = documents.import_camera('{"samples": [{"frame": 30, "position": [0, -5, 0], "target": [0, 0, 0], "focal_length": 50}, {"frame": 1, "position": [0, -6, 0], "orientation": [0, 0, 0, 1], "fov": 40}]}')
    assert error is None and [k["duration"] for k in keys] == [29, 0] and keys[0]["fov"] == 40
    assert documents.import_camera("{}")[1]


def test_parse_column(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{}"), (3, "nope"), (4, None)], "id int, props string")
    got = values(documents.parse_column(df, "props", "k bigint, c string", {"k": -1, "c": "viridis"}).orderBy("id"), "id", "k", "c", "corrupt")
    assert got == [(1, 3, "viridis", False), (2, -1, "viridis", False), (3, -1, "viridis", True), (4, -1, "viridis", True)]


# Streams


def test_streaming_sessions_match_batch(spark, tmp_path):
    from cloudloom.streaming import sessions

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.sessions(sessions.read_events(spark, str(tmp_path / "in"), src.schema), "30 minutes")
    got = sessions.run_once(stream, "sessions_test", str(tmp_path / "ck"))
    batch = src.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    want = {(r["user_id"], r["w"]["start"]): r["n"] for r in batch.collect()}
    found = {(r["user_id"], r["begin"]): r["events"] for r in got.collect()}
    assert found and all(want[k] == n for k, n in found.items())
