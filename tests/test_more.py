"""The engine against worked examples: global ranks with payload, spaced picks, nearest search, styles, caches, jobs; and SQL for the queries."""

import numpy as np
from pyspark.sql import functions as F

from cloudloom.functions import style
from cloudloom.operators import sampling, spatial
from cloudloom.sources import caches, documents


def test_ranks_keep_with_a_payload(spark):
    """Two million rows with other columns: the ranks are those of one sort of the whole table."""
    n = 2_000_000
    rows = spark.range(n).select((F.xxhash64("id") % 5000 / 7).alias("v"), F.col("id").alias("point_index"), F.rand(3).alias("x"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    got = sampling.ranked(rows, ["v", "point_index"]).select("v", "point_index", "rank", "name").toPandas().sort_values(["v", "point_index"])
    assert (got["rank"].to_numpy() == np.arange(n)).all() and (got["name"] == "n" + got["point_index"].astype(str)).all()


def test_ranks_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1), (2.0, 3), (2.0, 2), (None, 0)], "v double, point_index long")
    assert [r["rank"] for r in sampling.ranked(rows, ["v", "point_index"]).orderBy("v", "point_index").collect()] == [0, 1, 2, 3]
    assert sampling.ranked(rows.limit(0), ["v"]).count() == 0


def test_spaced_goes_on_until_enough(spark):
    """The best 3,000 candidates lie in one place: the second pick is far below them."""
    rows = [(float(10_000 - i), 0.001 * (i % 7), 0.0, 0.0, i) for i in range(3000)] + [(5.0, 3.0, 0.0, 0.0, 9000), (4.0, 6.0, 0.0, 0.0, 9001)]
    df = spark.createDataFrame(rows, "score double, x double, y double, z double, point_index long")
    assert [t[4] for t in sampling.spaced(df, 1.0, 3, block=64)] == [0, 9000, 9001]
    assert [t[4] for t in sampling.spaced(df, 1.0, 9, block=64)] == [0, 9000, 9001]
    assert sampling.spaced(df.limit(0), 1.0, 3) == []


def test_nearest_widens_until_found(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(20)], "point_index long, x double, y double, z double")
    asked = spark.createDataFrame([(1, 3.2, 0.0, 0.0), (2, -500.0, 0.0, 0.0), (3, 12.0, 90.0, 0.0)], "query_id long, x double, y double, z double")
    got = {r["query_id"]: r["point_index"] for r in spatial.nearest(asked, points, 0.5).collect()}
    assert got == {1: 3, 2: 0, 3: 12}
    assert spatial.nearest(asked, points.limit(0), 0.5).count() == 0


def test_materials(spark):
    plain = {
        "depth_contribution": "none", "geometry_mode": "screen_sprites", "sprite_size_mode": "pixels", "color_mode": "solid_color", "falloff": "hard_disc", "stylisation": "off",
        "stylisation_strength": 0.0, "motion_amount": 0.0, "motion_speed": 0.0, "caustics_enabled": False, "caustic_intensity": 0.0, "caustic_tint": 0.0, "caustic_fields": False,
        "animated": False, "colourise_amount": 0.0,
    }
    bindings = {"point_size": 2.0, "surfel_diameter": 0.01, "opacity": 1.0, "emissive_strength": 0.0, "xray_strength": 0.0, "depth_fade": 0.0, "colormap_position": 0.5}

    def made(changes, **bound):
        own = {k: style.binding(v) for k, v in bindings.items()} | bound
        s = F.struct(*[F.lit(v).alias(k) for k, v in (plain | changes).items()], *[b.alias(k) for k, b in own.items()])
        return spark.range(1).select(style.material(s)).first()[0]

    assert made({}) == "opaque_hard_disc"
    assert made({"falloff": "gaussian"}) == made({}, opacity=style.binding(0.5)) == made({"colourise_amount": 0.2}) == "constant_simple"
    assert made({}, opacity=style.binding(0.2, active=False)) == "opaque_hard_disc"  # an inactive binding is its default
    for change in ({"animated": True}, {"stylisation": "brush_particles", "stylisation_strength": 1.0}, {"motion_amount": 1.0, "motion_speed": 1.0}, {"color_mode": "scalar_colormap"}):
        assert made(change) == "unified"
    assert made({}, xray_strength=style.binding(0.4)) == made({}, depth_fade=style.binding(0.4)) == made({}, point_size=style.binding(1.0, mode="field_mapped")) == "unified"


def test_path_caches_round_trip(spark):
    text = '{"branches": [{"branch_id": 7, "branch_role": "spread", "termination": "loop", "anchors": [{"position": [1, 2, 3], "gap_count": 2}, {}]}, {"branch_id": 8}]}'
    docs = spark.createDataFrame([("a", text), ("b", "no json"), ("c", None), ("d", "{}")], "source string, document string")
    branches, anchors = caches.path_cache_tables(docs, "document")
    assert [tuple(r) for r in branches.orderBy("branch_id").collect()] == [("a", 7, 0, -1, "spread", "loop"), ("a", 8, 0, -1, "main", "reached_length")]
    assert [(r["seq"], r["x"], r["nz"], r["gap_count"], r["confidence"]) for r in anchors.orderBy("seq").collect()] == [(0, 1.0, 1.0, 2, 1.0), (1, 0.0, 1.0, 0, 1.0)]
    again = caches.path_cache_column(branches, anchors, "source")
    parsed, issue = documents.loads(again.first()["document"], "path_cache")
    assert issue is None and [b["branch_id"] for b in parsed["branches"]] == [7, 8] and parsed["branches"][0]["anchors"][0]["position"] == [1.0, 2.0, 3.0]
    assert sorted(map(tuple, caches.path_cache_tables(again, "document")[1].collect())) == sorted(map(tuple, anchors.collect()))


def test_field_caches(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.5), (2, 1.5)], "point_index long, wetness double")
    caches.save_field_cache(nodes, {"resolution": 0.1}, str(tmp_path / "c"))
    got, settings, issue = caches.load_field_cache(spark, str(tmp_path / "c"))
    assert issue is None and settings == {"resolution": 0.1} and sorted(map(tuple, got.collect())) == [(1, 0.5), (2, 1.5)]
    spark.createDataFrame([(99, "{}")], "version int, settings string").write.mode("overwrite").parquet(str(tmp_path / "c/about"))
    assert caches.load_field_cache(spark, str(tmp_path / "c"))[0] is None
    assert caches.load_field_cache(spark, str(tmp_path / "nowhere"))[2]


def test_jobs_and_paths():
    job = caches.render_job({"width": -5, "tile": 4, "first_frame": 9, "last_frame": 2, "fps": 0})
    assert (job["width"], job["height"], job["tile"], job["last_frame"], job["fps"]) == (1, 1080, 16, 9, 1)
    assert caches.path_array(["a\\b", "", None, 3, "c"]) == ["a/b", "c"] and caches.path_array(None) == []
    assert documents.project({"jobs": [{"fps": 24}]})["jobs"][0]["fps"] == 24


def test_queries_and_sql_belong_together():
    """Each SQL text is of a query, and most queries of the engine have one."""
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    core = [q for q in queries if not q.startswith("op") and q != "pipeline"]
    assert set(sql) <= set(queries) and sum(q in sql for q in core) > 0.85 * len(core)


def test_pattern_properties():
    """What each procedural pattern keeps: values in 0..1, the same for the same seed, other for another, moving in time, neither empty nor full, denser with density."""
    from dataclasses import replace

    from cloudloom.functions import patterns

    rng = np.random.default_rng(3)
    u, v = rng.uniform(-3, 3, 4000), rng.uniform(-3, 3, 4000)
    seeded = [k for k in patterns.TYPES if k not in ("radial",)]
    denser = ("rain_rings", "tide_bands", "wet_sheen", "current_threads", "droplet_glints", "drip_trails", "foam_sparkle")
    for kind in patterns.TYPES:
        p = patterns.DEFAULTS[kind]
        at = lambda t=0.4, seed=5, p=p: patterns.evaluate(p, u, v, t, seed)
        first = at()
        assert np.isfinite(first).all() and first.min() >= 0 and first.max() <= 1, kind
        assert (first == at()).all() and np.abs(first - at(t=1.7)).max() > 0.05, kind
        assert 0.0005 < first.mean() < 0.9 and first.std() > 0.01, (kind, first.mean(), first.std())
        if kind in seeded:
            assert np.abs(first - at(seed=6)).max() > 0.05, kind
        if kind in denser:
            assert at(p=replace(p, density=0.9)).mean() >= at(p=replace(p, density=0.1)).mean(), kind
    flat = replace(patterns.DEFAULTS["linear"], warp=0.0)
    want = (0.5 + 0.5 * np.cos(2 * np.pi * (u / flat.wavelength - flat.phase - 0.4 * flat.speed))) ** 4
    assert np.allclose(patterns.evaluate(flat, u, v, 0.4), want)
    assert (patterns.evaluate(replace(flat, kind="no such"), u, v, 0.4) == patterns.evaluate(flat, u, v, 0.4)).all()
