"""Neighbour searches against brute force, and plans that hold at size."""

import numpy as np
import pytest

from cloudloom.functions import scalar as S
from cloudloom.operators import paths, raster, spatial, tiles


def cloud(n, seed=1):
    at = np.random.default_rng(seed).integers(0, 40, (n, 3)) / 40 * [1.0, 1.0, 0.2]
    return [(i, *map(float, p)) for i, p in enumerate(at)]


PLACE = "point_index long, x double, y double, z double"


def near(rows, others, radius):
    a, b = np.array([r[1:] for r in rows]), np.array([r[1:] for r in others])
    return ((a[:, None] - b[None]) ** 2).sum(-1), radius


def test_copies_of_pixels_are_not_broadcast(spark, tmp_path):
    """a small file with many copies of each row."""
    spark.range(1000).selectExpr("cast(id % 20 as int) ix", "cast(id div 20 as int) iy", "2.0 + id % 7 as depth").write.parquet(str(tmp_path / "p"))
    pixels = spark.read.parquet(str(tmp_path / "p"))
    both = raster._spread(pixels, raster.ring_offsets(2.0), ["depth"]).join(pixels, ["ix", "iy"])
    plan = both._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_surfel_basis_is_staged(spark):
    """written out in one expression, the basis has more terms than a driver holds."""
    df = spark.createDataFrame([(0.0, 0.0, 2.0), (3.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 2.0, 3.0)], "x double, y double, z double")
    out = raster.surfel_basis(df, S.vec("x", "y", "z"))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    for r in out.collect():
        n = np.array([r.x, r.y, r.z]) / np.linalg.norm([r.x, r.y, r.z]) if r.x or r.y or r.z else np.array([0.0, 0.0, 1.0])
        u, v = np.array([r.u_x, r.u_y, r.u_z]), np.array([r.v_x, r.v_y, r.v_z])
        assert [u @ n, v @ n, u @ v, u @ u, v @ v] == pytest.approx([0, 0, 0, 1, 1])


def test_far_queries_meet_few_boxes(spark, monkeypatch):
    """exact nearest points of far queries, with more points than boxes, ties to the smaller index."""
    monkeypatch.setattr(spatial, "BOXES", 16)
    rows = cloud(900, 5)
    asked = [(k, 40 + k / 7, (k % 5) / 5, 0.05) for k in range(30)] + [(99, -3.0, 9.0, 0.0)]
    d2, _ = near(asked, rows, 1)
    got = {r[0]: r[1] for r in spatial.nearest(spark.createDataFrame(asked, "query_id long, x double, y double, z double"), spark.createDataFrame(rows, PLACE), 0.01).collect()}
    assert {q[0]: d2[i][got[q[0]]] for i, q in enumerate(asked)} == {q[0]: d2[i].min() for i, q in enumerate(asked)}


def test_walks_search_for_their_nodes_alone(spark):
    """links are made for the nodes on a walk, not for all."""
    n = spark.range(400).selectExpr("id point_index", "id * 0.1 x", "0.0D y", "0.0D z", "1.0D dx", "0.0D dy", "0.0D dz", "1.0D confidence")
    asked, plain = [], spatial.next_field_node
    spatial.next_field_node = lambda nodes, radius, of=None: asked.append(of.count()) or plain(nodes, radius, of)
    try:
        walk = paths.field_walks(n, spark.createDataFrame([(5, 0), (6, 396)], "seed_id long, point_index long"), 0.15, 6).collect()
    finally:
        spatial.next_field_node = plain
    assert sorted((r[0], r[1], r[2]) for r in walk) == [(5, k, k) for k in range(6)] + [(6, k, 396 + k) for k in range(4)]
    assert sum(asked) <= 10
def test_suggestions_count_all_neighbours(spark):
    """the neighbours of a candidate are summed up beside it, existing emitters at one place are one."""
    support = spark.createDataFrame(cloud(400, 7), PLACE).selectExpr("*", "0.9 confidence")
    existing = spark.range(2000).selectExpr("id emitter_id", "0.1D x", "0.1D y", "0.1D z")
    got = {int(t[4]): t[0] for t in paths.suggest_emitters(support, existing, radius=0.2, k=4)}
    rows = cloud(400, 7)
    d2, r = near(rows, rows, 0.2)
    for i, score in got.items():
        others = [j for j in range(400) if j != i and d2[i, j] <= tiles.squared(r)]
        drop = np.mean([np.clip((rows[i][3] - rows[j][3]) / r, -1, 1) for j in others])
        assert score == pytest.approx(0.45 + 0.35 * np.clip(drop + 0.5, 0, 1) + 0.15 * min(1, len(others) / 8))
    assert len(got) == 4


def test_next_node_without_pairs(spark):
    """the best next node by brute force, ties to the smaller one; nodes asked for alone get the same."""
    rows = cloud(500, 2)
    df = spark.createDataFrame(rows, PLACE).selectExpr("*", "1.0 dx", "0.0 dy", "0.0 dz", "point_index % 3 / 3 confidence")
    d2, r = near(rows, rows, 0.12)
    want = {}
    for i, a in enumerate(rows):
        found = [(2 * (b[1] - a[1]) / max(d2[i, j] ** 0.5, 1e-9) + 0.35 * (j % 3 / 3) - d2[i, j] ** 0.5 / r, -j) for j, b in enumerate(rows) if j != i and d2[i, j] <= tiles.squared(r) and (b[1] - a[1]) / max(d2[i, j] ** 0.5, 1e-9) >= -0.15]
        if found:
            want[i] = -max(found)[1]
    out = spatial.next_field_node(df, r)
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {p: n for p, n, _ in out.collect()} == want
    assert {p: n for p, n, _ in spatial.next_field_node(df, r, df.where("point_index < 9")).collect()} == {k: v for k, v in want.items() if k < 9}


def test_effects_at_one_place_are_matched_once(spark):
    """F8: many effects at one place are one search."""
    points = spark.createDataFrame(cloud(400, 3), PLACE)
    effects = spark.range(3000).selectExpr("id effect_id", "-1L source_point_index", "id % 3 / 4 x", "0.5D y", "0.1D z")
    got = {r[0]: r[1] for r in spatial.match_effects(effects, points, 0.2).collect()}
    d2, r = near([(k, k / 4, 0.5, 0.1) for k in range(3)], cloud(400, 3), 0.2)
    best = [int(np.lexsort((np.arange(400), x))[0]) for x in d2]
    assert got == {k: best[k % 3] for k in range(3000) if d2[k % 3].min() <= tiles.squared(r)}
    calls = []
    plain = tiles.gathered
    spatial.tiles.gathered = lambda left, *a, **k: calls.append(left.count()) or plain(left, *a, **k)
    try:
        spatial.match_effects(effects, points, 0.2)
    finally:
        spatial.tiles.gathered = plain
    assert calls == [3]


def test_counts_without_pairs(spark):
    """counts equal brute force, and no row is copied to cells for a broadcast."""
    rows = cloud(700)
    d2, r = near(rows, rows, 0.1)
    df = spark.createDataFrame(rows, PLACE)
    out = spatial.neighbour_counts(df, r)
    want = {i: int(n) for i, n in enumerate((d2 <= tiles.squared(r)).sum(1) - 1) if n}
    assert {k: n for k, n in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()
    assert spatial.neighbour_counts(df.limit(0), r).count() == 0


def test_ranks_without_pairs(spark):
    """ranks are by score, then by index, and each point's are whole; no pair is shuffled."""
    df = spark.createDataFrame(cloud(500, 4), PLACE).selectExpr("*", "0.0 nx", "0.0 ny", "1.0 nz", "point_index % 2 / 2 confidence")
    out = spatial.ranked_neighbours(df, 0.12, bridge=0.05, branching=0.3)
    assert "Window" not in out._jdf.queryExecution().sparkPlan().toString()
    rows = sorted(out.collect(), key=lambda r: (r.point_index, r["rank"]))
    for a, b in zip(rows, rows[1:]):
        if a.point_index == b.point_index:
            assert b["rank"] == a["rank"] + 1 and (round(a.score, 6), -a.other) > (round(b.score, 6), -b.other)
        else:
            assert b["rank"] == 1
    few = {(r.point_index, r.other) for r in spatial.ranked_neighbours(df, 0.12, bridge=0.05, branching=0.3, most=2).collect()}
    assert few == {(r.point_index, r.other) for r in rows if r["rank"] <= 2}


def test_support_is_whole(spark):
    """all points support a path unless a bake limits its samples."""
    df = spark.range(900_001).selectExpr("id point_index", "0.0D x", "0.0D y", "0.0D z")
    assert paths.support_graph(df, 900_001, paths.Bake()).count() == 900_001
    assert paths.support_graph(df, 900_001, paths.Bake(sample_limit=450_000)).count() == 300_001


def test_exclusion_at_the_radius(spark):
    """a point whose squared distance is between 0.0025 and 0.05 * 0.05 is beyond a radius of 0.05."""
    assert tiles.squared(0.05) == 0.0025 < 0.05 * 0.05
    x = float(np.sqrt(0.0025))
    while x * x <= 0.0025:
        x = float(np.nextafter(x, 1))
    c = spark.createDataFrame([(1, x, 0.0, 0.0), (2, 0.05 - 1e-9, 0.0, 0.0)], "candidate_id long, x double, y double, z double")
    beyond = {1} if x * x > 0.0025 else set()
    got = {r[0] for r in spatial.exclude_near(c, spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double"), 0.05).select("candidate_id").collect()}
    assert got == beyond == {1}


def test_traces_are_walked_once_a_start(spark, monkeypatch):
    """many emitters at one place are one walk, which ranks the steps of its own points alone; far emitters walk from their nearest point as well."""
    bake = paths.Bake(voxel=0.02, bridge=0.05, radius=0.12, length=0.3, steps=24, branches=4)
    support = paths.support_graph(spark.createDataFrame(cloud(400, 9), PLACE).selectExpr("*", "0.0D nx", "0.0D ny", "1.0D nz"), 400, bake)
    emitters = spark.range(600).selectExpr("id emitter_id", "if(id % 3 = 2, 9.0D, id % 3 / 2) x", "0.5D y", "0.1D z")
    out = paths.trace(emitters, support, bake)
    assert out.columns == "emitter_id branch_id parent_id role seq point_index path_distance confidence gaps stop".split()
    got = {}
    for r in out.collect():
        got.setdefault(r[0], []).append(tuple(r[1:]))
    starts = {r[0]: r[1] for r in paths.snap_emitters(emitters, support, bake.radius).collect()}
    confidence = {r[0]: r[1] for r in support.select("point_index", "confidence").collect()}
    steps = {}
    for r in sorted(spatial.ranked_neighbours(support, bake.radius, bridge=bake.bridge, branching=bake.branching, tolerance=bake.tolerance, most=4).collect(), key=lambda r: r["rank"]):
        steps.setdefault(r.point_index, []).append((r.other, r.score, r.distance, confidence[r.point_index]))

    class Plain:
        get = staticmethod(lambda point: steps.get(point, []))

    assert len(got) == 600 and len(set(starts.values())) == 3
    for e in range(600):
        assert sorted(got[e]) == sorted(t[1:] for t in paths._walk(starts[e], Plain, bake))
    assert "FlatMapGroups" not in out._jdf.queryExecution().sparkPlan().toString()
