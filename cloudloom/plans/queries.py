"""One query for each operator, over the views of the star schema, with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import color, patterns
from cloudloom.functions import scalar as S
from cloudloom.operators import camera, compose, paths, raster, regions, sampling, spatial, splats, stats, timeseries
from cloudloom.plans import views as V
from cloudloom.plans.registry import query
from cloudloom.sources import assets, documents


def _round(df: DataFrame, digits: int = 6, only=None) -> DataFrame:
    """Doubles rounded, so that the order in which sums were added does not show; adding 0.0 makes -0.0 plain 0."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float") and (only is None or f.name in only)]
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names}) if names else df


def _rounded(sql: str, names: str, digits: int = 6, rest: str = "") -> str:
    cols = ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names.split())
    return f"SELECT {rest + ', ' if rest else ''}{cols} FROM ({sql})"


# Statistics

_L = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("a1_field_stats", " UNION ALL ".join(f"SELECT '{f}' AS field, min({f}) + 0.0 AS min, max({f}) + 0.0 AS max, count({f}) AS count FROM lineitem" for f in _L))
def a1(spark, d):
    return stats.field_stats(V.table(spark, d, "lineitem").select(*_L), _L)


@query("a2_bounds", f"SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, count(*) > 0 AS valid FROM {V.P}")
def a2(spark, d):
    return stats.bounds(V.cloud_p(spark, d))


@query("a3_upper_median", f"SELECT x, list_sort(list(v))[count(*) // 2 + 1] AS median FROM {V.Q} GROUP BY x")
def a3(spark, d):
    return V.cloud_q(spark, d).groupBy("x").agg(stats.upper_median(F.col("v")).alias("median"))


@query("a3_upper_median_large", "SELECT list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem")
def a3_large(spark, d):
    value = stats.upper_median_of(V.table(spark, d, "lineitem"), "l_extendedprice")
    return spark.createDataFrame([(value,)], "median double")


_STRIDED = f"SELECT * FROM {V.P} WHERE point_index % greatest(1, ceil((SELECT count(*) FROM orders) / 16384)::bigint) = 0"


@query(
    "a4_cloud_focus",
    f"""WITH s AS ({_STRIDED}), m AS (SELECT list_sort(list(x))[count(*) // 2 + 1] AS mx, list_sort(list(y))[count(*) // 2 + 1] AS my, list_sort(list(z))[count(*) // 2 + 1] AS mz FROM s)
    SELECT x, y, z FROM s, m ORDER BY (x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), point_index LIMIT 1""",
)
def a4(spark, d):
    p = V.cloud_p(spark, d)
    return stats.cloud_focus(p, p.count())


@query("a5_splat_focus", f"SELECT {', '.join(f'list_sort(list({a}))[count(*) // 2 + 1] AS {a}' for a in 'xyz')} FROM {V.SPLATS} WHERE point_index < 16384")
def a5(spark, d):
    return stats.splat_focus(V.splats(spark, d))


def _voxel_sql(source: str, depth: int) -> str:
    n = 2**depth
    key = lambda a: f"floor(least(greatest(({a} - lo_{a}) / (hi_{a} - lo_{a}), 0), 0.999999999999) * {n})::bigint"
    off = lambda a: f"({a} - (lo_{a} + (c{a} + 0.5) / {n} * (hi_{a} - lo_{a})))"
    return f"""WITH p AS (SELECT * FROM {source}), b AS (SELECT {', '.join(f'min({a}) AS lo_{a}, max({a}) AS hi_{a}' for a in 'xyz')} FROM p),
    k AS (SELECT p.*, b.*, {', '.join(f'{key(a)} AS c{a}' for a in 'xyz')} FROM p, b),
    e AS (SELECT *, {' + '.join(f'{off(a)} * {off(a)}' for a in 'xyz')} AS d2 FROM k)
    SELECT cx, cy, cz, point_index, d2 FROM e QUALIFY row_number() OVER (PARTITION BY cx, cy, cz ORDER BY d2, point_index) = 1"""


@query("a6_voxel_representative", f"SELECT cx, cy, cz, point_index FROM ({_voxel_sql(V.Q, 3)})")
def a6(spark, d):
    q = V.cloud_q(spark, d)
    return stats.voxel_representatives(q, stats.bounds(q).first().asDict(), 3).select("cx", "cy", "cz", "point_index")


_FLAGSHIP = f"""WITH r AS ({_voxel_sql(V.Q, 3)}), s AS (SELECT min(v) AS lo, max(v) AS hi FROM {V.Q})
    SELECT cx, cy, cz, r.point_index, round(1 + 7 * pow(least(greatest((v - lo) / greatest(hi - lo, 1e-5), 0), 1), 2), 6) AS size FROM r JOIN {V.Q} q USING (point_index), s"""


@query("m0_mapped_representatives", _FLAGSHIP)
def flagship(spark, d):
    """The best representative part of each voxel with its mapped size: A1, A2, A6, E1, E2, E76."""
    q = V.cloud_q(spark, d)
    box = stats.bounds(q).withColumn("k", F.lit(0)).join(q.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))).first()
    size = S.evaluate(S.Binding(field="v", gamma=2.0, out_lo=1.0, out_hi=8.0), stats=S.Stats(box["lo"], box["hi"]))
    best = stats.voxel_representatives(q, box.asDict(), 3)
    return best.join(q.select("point_index", F.round(size, 6).alias("size")), "point_index").select("cx", "cy", "cz", "point_index", "size")


@query(
    "a7_surface_cells",
    _rounded(f"SELECT floor(x / 50)::bigint AS cx, floor(y / 50)::bigint AS cy, avg(x) AS x, avg(y) AS y, avg(z) AS z, min(z) AS min_z, max(z) AS max_z, count(*) AS count, least(1, 0.35 * sqrt(count(*))) AS confidence FROM {V.P} GROUP BY 1, 2", "x y z min_z max_z confidence", rest="cx, cy, count"),
)
def a7(spark, d):
    return _round(stats.surface_cells(V.cloud_p(spark, d), 50.0))


@query("a9_centroid", "SELECT s_nationkey, round(avg(s_suppkey), 6) AS x, round(avg(s_acctbal), 6) AS y FROM supplier GROUP BY 1")
def a9(spark, d):
    vertex = F.struct(F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"), F.lit(0.0).alias("z"))
    grouped = V.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(vertex).alias("v"))
    x, y, _ = stats.centroid(F.col("v"))
    return _round(grouped.select("s_nationkey", x.alias("x"), y.alias("y")))


_STEP = "coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0)"
_STEPS = f"(SELECT *, {_STEP} AS step FROM {V.PATHS} WINDOW w AS (PARTITION BY path_id ORDER BY seq))"


@query("a10_path_length", f"SELECT path_id, round(sum(step), 6) AS length FROM {_STEPS} GROUP BY 1")
def a10(spark, d):
    return _round(timeseries.path_lengths(V.paths(spark, d)))


@query("a12_branch_diagnostics", f"SELECT (SELECT count(*) FROM nation) AS branches, round(avg(confidence), 6) AS mean_confidence, sum((confidence < 0.45 OR event_id % 4 >= 2)::int)::bigint AS low_confidence FROM {V.NODES}")
def a12(spark, d):
    anchors = V.nodes(spark, d).withColumn("gaps", F.col("event_id") % 4)
    return _round(stats.branch_diagnostics(V.table(spark, d, "nation"), anchors))


@query(
    "a13_merge_caches",
    """WITH n AS (SELECT s_nationkey AS source_id, s_suppkey AS branch_id, s_suppkey - 25 AS parent_id, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS new_id FROM supplier)
    SELECT n.source_id, n.branch_id, n.new_id, coalesce(p.new_id, -1) AS new_parent FROM n LEFT JOIN n p ON p.source_id = n.source_id AND p.branch_id = n.parent_id""",
)
def a13(spark, d):
    s = V.table(spark, d, "supplier")
    return stats.merge_caches(s.select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("branch_id"), (F.col("s_suppkey") - 25).alias("parent_id")))


@query("a14_unique_indices", "SELECT DISTINCT l_partkey AS point_index FROM lineitem WHERE l_partkey BETWEEN 0 AND 999")
def a14(spark, d):
    return stats.unique_indices(V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("point_index")), 1000)


@query("a15_csr_ranges", "WITH c AS (SELECT l_orderkey AS point_index, count(*) AS count FROM lineitem GROUP BY 1) SELECT point_index, coalesce(sum(count) OVER (ORDER BY point_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start, count FROM c")
def a15(spark, d):
    return stats.csr_ranges(V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("point_index")))


# Samples, orders

@query("s2_coprime_sample", "WITH t AS (SELECT count(*) AS n FROM orders), s AS (SELECT n, min(c) AS step FROM t, range(0, 200) r(k), LATERAL (SELECT (n // 2 | 1) + 2 * k AS c) WHERE gcd(c, n) = 1 GROUP BY 1) SELECT DISTINCT ((11400714819323198485::hugeint % n + i * step) % n)::bigint AS point_index FROM s, range(1000) r(i)")
def s2(spark, d):
    return sampling.coprime_sample(spark, V.table(spark, d, "orders").count(), 1000)


_RANKED_Q = f"(SELECT *, row_number() OVER (ORDER BY v, point_index) - 1 AS rank, count(*) OVER () AS n FROM {V.Q})"
_MID = "least(n - 1, i * n // 100 + (greatest((i + 1) * n // 100, i * n // 100 + 1) - i * n // 100) // 2)"


@query("s3_stratified", f"SELECT point_index FROM {_RANKED_Q} JOIN range(100) r(i) ON rank = {_MID}")
def s3(spark, d):
    q = sampling.ranked(V.cloud_q(spark, d), ["v", "point_index"])
    return sampling.stratified(q, q.count(), 100)


@query("s4_spatial_sample")
def s4(spark, d):
    return sampling.spatial_sample(V.cloud_q(spark, d), 200)


def _morton_sql(keys, depth):
    return " | ".join(f"((({k} >> {b}) & 1) << {3 * b + 2 - i})" for b in range(depth) for i, k in enumerate(keys))


@query("s5_morton", f"SELECT point_index, {_morton_sql(['(point_index % 64)', '(point_index // 64 % 64)', '(point_index // 4096 % 64)'], 6)} AS morton FROM {V.P}")
def s5(spark, d):
    k = F.col("point_index")
    keys = [k % 64, F.floor(k / 64) % 64, F.floor(k / 4096) % 64]
    return V.cloud_p(spark, d).select("point_index", S.morton(keys, 6).alias("morton"))


@query("s7_decimate", "SELECT i * (SELECT count(*) FROM orders) // 777 AS point_index FROM range(777) r(i)")
def s7(spark, d):
    return sampling.decimate(spark, V.table(spark, d, "orders").count(), 777)


@query("s8_stride_sample", f"SELECT point_index, x FROM {V.P} WHERE point_index % ceil((SELECT count(*) FROM orders) / 1000)::bigint = 0")
def s8(spark, d):
    p = V.cloud_p(spark, d)
    return stats.stride(p, p.count(), 1000).select("point_index", "x")


@query("s9_surfel_corners", f"SELECT point_index * 6 + i AS corner FROM {V.Q}, range(6) r(i)")
def s9(spark, d):
    return sampling.surfel_corners(V.cloud_q(spark, d))


@query(
    "s11_greedy_spaced",
    f"""WITH RECURSIVE g AS (SELECT 1 AS n, [arg_min({{'i': point_index, 'x': x, 'y': y, 'z': z}}, (-v, x, y, z, point_index))] AS taken FROM {V.FLAT_Q}
      UNION ALL SELECT n + 1, list_append(taken, arg_min({{'i': point_index, 'x': x, 'y': y, 'z': z}}, (-v, x, y, z, point_index))) FROM g, {V.FLAT_Q} c
      WHERE n < 10 AND len(list_filter(taken, lambda t: pow(t.x - c.x, 2) + pow(t.y - c.y, 2) + pow(t.z - c.z, 2) <= 0.1::double * 0.1::double)) = 0 GROUP BY n, taken)
    SELECT unnest(list_transform(taken, lambda t: t.i)) AS point_index FROM (SELECT taken FROM g ORDER BY n DESC LIMIT 1)""",
)
def s11(spark, d):
    top = sampling.spaced(V.flat_q(spark, d).withColumnRenamed("v", "score"), 0.1, 10)
    return spark.createDataFrame([(t[4],) for t in top], "point_index long")


@query("o1_node_order", f"SELECT path_id, event_id, (row_number() OVER w - 1)::bigint AS seq, round(y - first(y) OVER w, 6) AS station FROM {V.PATHS} WINDOW w AS (PARTITION BY path_id ORDER BY round(y, 5), round(z, 5), x, event_id)")
def o1(spark, d):
    p = V.paths(spark, d).select("path_id", "event_id", F.col("y").alias("station"), F.col("z").alias("y"), "x", F.col("event_id").alias("point_index"))
    return _round(timeseries.node_order(p).select("path_id", "event_id", F.col("seq").cast("long").alias("seq"), "station"))


@query(
    "o2_back_to_front",
    f"""WITH s AS (SELECT point_index AS merged_index, z AS view_depth, min(z) OVER () AS lo, max(z) OVER () AS hi FROM {V.SPLATS}), b AS (SELECT *, least(floor((view_depth - lo) / (hi - lo) * 2047), 2047)::int AS bucket FROM s)
    SELECT merged_index, bucket, (row_number() OVER (ORDER BY bucket DESC, merged_index) - 1)::bigint AS draw FROM b""",
)
def o2(spark, d):
    s = V.splats(spark, d).select(F.col("point_index").alias("merged_index"), F.col("z").alias("view_depth"))
    return sampling.back_to_front(s).select("merged_index", "bucket", F.col("draw").cast("long").alias("draw"))


@query("o3_layer_offsets", f"WITH c AS (SELECT layer, count(*) AS count FROM {V.SPLATS} GROUP BY 1) SELECT layer, count, coalesce(sum(count) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM c")
def o3(spark, d):
    return sampling.layer_offsets(V.splats(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("count")))


# Filters and regions

C_SHAPE = [(5.0, 905.0, 0.0), (45.0, 905.0, 0.0), (45.0, 925.0, 0.0), (15.0, 925.0, 0.0), (15.0, 965.0, 0.0), (45.0, 965.0, 0.0), (45.0, 990.0, 0.0), (5.0, 990.0, 0.0)]


def _edges():
    return [(C_SHAPE[i], C_SHAPE[i - 1]) for i in range(len(C_SHAPE))]


def _inside_sql(x="x", y="y"):
    return "(" + " + ".join(f"(({a[1]} > {y}) <> ({b[1]} > {y}) AND {x} < ({b[0]} - {a[0]}) * ({y} - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]})::int" for a, b in _edges() if abs(a[1] - b[1]) > 1e-8) + ") % 2 = 1"


def _distance_sql(n):
    out = []
    for a, b in _edges():
        ab = [q - r for q, r in zip(b, a)][:n]
        k = sum(c * c for c in ab)
        t = "least(greatest((" + " + ".join(f"({c} - {a[i]}) * {ab[i]}" for i, c in enumerate("xyz"[:n])) + f") / {k}, 0), 1)"
        out.append("sqrt(" + " + ".join(f"pow({c} - ({a[i]} + {ab[i]} * {t}), 2)" for i, c in enumerate("xyz"[:n])) + ")")
    return f"least({', '.join(out)})"


@query("f1_point_in_polygon", f"SELECT point_index FROM {V.Q} WHERE {_inside_sql()}")
def f1(spark, d):
    return V.cloud_q(spark, d).where(regions.inside(F.col("x"), F.col("y"), C_SHAPE)).select("point_index")


@query("f3_visible_in_clip", f"SELECT point_index FROM {V.Q} WHERE abs((x - 25) / 10) <= 1 AND abs((y - 950) / 10) <= 1 AND abs(z / 100) <= 1")
def f3(spark, d):
    c = S.clip(S.vec("x", "y", "z"), camera.orthographic(25.0, 950.0, 10.0))
    return V.cloud_q(spark, d).where(S.in_clip(c)).select("point_index")


_TOUCHED = "(lx + (cx + 2) * ex / 16 >= {0} AND lx + (cx - 1) * ex / 16 <= {1} AND ly + (cy + 2) * ey / 16 >= {2} AND ly + (cy - 1) * ey / 16 <= {3})"


@query(
    "f6_frustum_union",
    f"""WITH b AS (SELECT min(x) AS lx, max(x) - min(x) AS ex, min(y) AS ly, max(y) - min(y) AS ey FROM {V.Q}),
    k AS (SELECT point_index, floor(least(greatest((x - lx) / ex, 0), 0.999999999999) * 16) AS cx, floor(least(greatest((y - ly) / ey, 0), 0.999999999999) * 16) AS cy, b.* FROM {V.Q}, b)
    SELECT point_index FROM k WHERE {_TOUCHED.format(5, 15, 925, 935)} OR {_TOUCHED.format(35, 45, 965, 975)}""",
)
def f6(spark, d):
    kept, _ = sampling.frustum_union(V.cloud_q(spark, d), [camera.orthographic(10.0, 930.0, 5.0), camera.orthographic(40.0, 970.0, 5.0)], 16)
    return kept.select("point_index")


_BLEND = 4.0


@query(
    "f10_region_selection",
    f"""WITH s AS (SELECT point_index, CASE WHEN d3 > 0 THEN d3 ELSE {_distance_sql(2)} END AS e FROM (SELECT *, {_distance_sql(3)} AS d3 FROM {V.Q} WHERE {_inside_sql()})), w AS (SELECT point_index, e, least(greatest(e / {_BLEND}, 0), 1) AS t FROM s)
    SELECT point_index, round(e, 6) AS edge_distance, round(t * t * (3 - 2 * t), 6) AS edge_weight, round(least(1, 0.35 + 0.65 * t * t * (3 - 2 * t)), 6) AS field_confidence FROM w""",
)
def f10(spark, d):
    chosen = regions.select_region(V.cloud_q(spark, d), C_SHAPE, blend=_BLEND)
    return _round(chosen.select("point_index", "edge_distance", "edge_weight", "field_confidence"))


def _layers(spark):
    v = lambda pts: [dict(x=float(a), y=float(b), z=0.0) for a, b in pts]
    rows = [(1, "ripple", True, False, v([(5, 905), (25, 905), (25, 950), (5, 950)])), (2, "ripple", False, True, v([(20, 940), (45, 940), (45, 940), (30, 990)])), (3, "ripple", False, False, v([(0, 900), (50, 900), (50, 1000)])), (4, "no_flow", True, True, v([(0, 900), (50, 900), (50, 1000)])), (5, "ripple", True, True, v([(0, 900), (50, 900)]))]
    return spark.createDataFrame(rows, "layer_id long, feature string, viewport boolean, export boolean, vertices array<struct<x:double,y:double,z:double>>")


def _poly_sql(pts):
    e = [(pts[i], pts[i - 1]) for i in range(len(pts))]
    return "(" + " + ".join(f"(({a[1]} > y) <> ({b[1]} > y) AND x < ({b[0]} - {a[0]})::double * (y - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]})::int" for a, b in e if a[1] != b[1]) + ") % 2 = 1"


@query("f11_regions_by_type", f"SELECT 1::bigint AS layer_id, point_index FROM {V.Q} WHERE {_poly_sql([(5, 905), (25, 905), (25, 950), (5, 950)])} UNION ALL SELECT 2::bigint, point_index FROM {V.Q} WHERE {_poly_sql([(20, 940), (45, 940), (30, 990)])}")
def f11(spark, d):
    return regions.select_regions(V.cloud_q(spark, d), _layers(spark), "ripple")


@query("f13_clip_stream", f"SELECT point_index, stream_role FROM (SELECT *, (point_index % 2)::double AS stream_role FROM {V.Q}) WHERE stream_role < 0.5 OR {_inside_sql()}")
def f13(spark, d):
    rows = V.cloud_q(spark, d).withColumn("stream_role", (F.col("point_index") % 2).cast("double"))
    return regions.clip_stream(rows, C_SHAPE).select("point_index", "stream_role")


@query("j13_control_flags", f"SELECT point_index, point_index % 3 = 0 AND point_index % 5 < 3 AS flow_blocked, point_index % 3 = 0 AND point_index % 7 = 0 AS bridge_allowed, false AS bridge_blocked FROM {V.Q}")
def j13(spark, d):
    q = V.cloud_q(spark, d).select("point_index")
    k = F.col("point_index")
    chosen = q.where(k % 3 == 0)
    one = chosen.select("point_index", (k % 5 < 3).alias("flow_blocked"), F.lit(False).alias("bridge_allowed"), F.lit(False).alias("bridge_blocked"))
    two = chosen.select("point_index", F.lit(False).alias("flow_blocked"), (k % 7 == 0).alias("bridge_allowed"), F.lit(False).alias("bridge_blocked"))
    return regions.control_flags(q, one.unionByName(two))


# Bindings, colours, scalar expressions

_N = "(v - lo) / greatest(hi - lo, 1e-5)"
_WITH_STATS = f"(SELECT * FROM {V.Q}, (SELECT min(v) AS lo, max(v) AS hi FROM {V.Q}))"


@query("e1_binding", f"SELECT point_index, round(pow(least(greatest(1 - {_N}, 0), 1), 2.2), 6) AS a, round(-1 + 4 * {_N}, 6) AS b, 2.5::double AS c, round(sign((v - 920) / 50) * pow(abs((v - 920) / 50), 0.5), 6) AS d FROM {_WITH_STATS}")
def e1(spark, d):
    q = V.cloud_q(spark, d)
    r = q.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    st = S.Stats(r["lo"], r["hi"])
    make = lambda **k: S.Binding(field="v", **k)
    return _round(q.select("point_index", S.evaluate(make(gamma=2.2, flags=S.CLAMP | S.INVERT | S.LAYER_STATS), stats=st).alias("a"), S.evaluate(make(out_lo=-1.0, out_hi=3.0, flags=S.LAYER_STATS), stats=st).alias("b"), S.evaluate(S.Binding(constant=2.5)).alias("c"), S.evaluate(make(lo=920.0, hi=970.0, gamma=0.5, flags=0), stats=st).alias("d")))


@query("e8_normalised_field", f"SELECT point_index, round(least(greatest({_N}, 0), 1), 6) AS n FROM {_WITH_STATS}")
def e8(spark, d):
    q = V.cloud_q(spark, d)
    st = q.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return _round(q.join(F.broadcast(st)).select("point_index", S.normalised(F.col("v"), F.col("lo"), F.col("hi")).alias("n")))


_T = "((point_index * 37 % 1000) / 999)"


# Published colours of one map at the places that the query asks for.
_TURBO = [(48, 18, 59), (63, 62, 156), (70, 102, 221), (69, 140, 253), (47, 178, 244), (26, 212, 208), (34, 235, 170), (82, 250, 122), (139, 255, 75), (183, 247, 53), (219, 226, 54), (245, 197, 58), (254, 161, 48), (249, 117, 29), (232, 75, 12), (206, 45, 4), (169, 22, 1), (122, 4, 3)]


def _turbo_sql(i):
    return f"round([{', '.join(str(rgb[i]) for rgb in _TURBO)}][point_index * 7 % 18 + 1] / 255, 6)"


@query("e10_lut_colormap", "SELECT point_index, " + ", ".join(f"{_turbo_sql(i)} AS {n}" for i, n in enumerate("rgb")) + f" FROM {V.Q}")
def e10(spark, d):
    t = (F.col("point_index") * 7 % 18) * 15 / 255
    return _round(V.cloud_q(spark, d).select("point_index", *[c.alias(n) for c, n in zip(color.colormap("turbo", t), "rgb")]))


# The stops of two piecewise linear maps: position, red, green, blue.
_TOPOGRAPHIC = [(0.0, 0.03, 0.12, 0.28), (0.16, 0.10, 0.36, 0.58), (0.28, 0.50, 0.76, 0.69), (0.34, 0.78, 0.70, 0.45), (0.48, 0.28, 0.55, 0.24), (0.64, 0.58, 0.50, 0.30), (0.80, 0.50, 0.42, 0.38), (1.0, 0.96, 0.95, 0.90)]
_FIRE = [(0.0, 0.0, 0.0, 0.0), (0.30, 0.25, 0.0, 0.06), (0.55, 0.85, 0.10, 0.02), (0.76, 1.0, 0.48, 0.0), (0.92, 1.0, 0.92, 0.20), (1.0, 1.0, 1.0, 0.92)]


def _stops_sql(stops, c, t):
    whens = " ".join(f"WHEN {t} <= {b[0]} THEN {a[c]}::double + ({b[c]}::double - {a[c]}::double) * ({t} - {a[0]}) / ({b[0]} - {a[0]})" for a, b in zip(stops, stops[1:]))
    return f"round(CASE {whens} ELSE {stops[-1][c]} END, 6)"


@query("e11_stop_colormaps", "SELECT point_index, " + ", ".join(f"{_stops_sql(_TOPOGRAPHIC, c + 1, 't')} AS t{n}, {_stops_sql(_FIRE, c + 1, 'f')} AS f{n}" for c, n in enumerate("rgb")) + f" FROM (SELECT point_index, {_T} AS t, (exp(3.0::double * {_T}) - 1) / (exp(3.0::double) - 1) AS f FROM {V.Q})")
def e11(spark, d):
    t = (F.col("point_index") * 37 % 1000) / 999
    maps = [(p, color.colormap(m, t)) for p, m in (("t", "topographic"), ("f", "exponential_fire"))]
    return _round(V.cloud_q(spark, d).select("point_index", *[c.alias(p + n) for p, rgb in maps for c, n in zip(rgb, "rgb")]))


@query("e13_gradient", f"SELECT point_index, round(1 - {_T}, 6) AS r, 0.0::double AS g, round({_T}, 6) AS b FROM {V.Q}")
def e13(spark, d):
    t = (F.col("point_index") * 37 % 1000) / 999
    return _round(V.cloud_q(spark, d).select("point_index", *[c.alias(n) for c, n in zip(color.gradient((1.0, 0.0, 0.0), (0.0, 0.0, 1.0), t), "rgb")]))


@query("e14_pack_unpack", f"SELECT point_index, (point_index % 256 + point_index * 7 % 256 * 256 + point_index * 11 % 256 * 65536 + 4278190080)::bigint AS packed, round((point_index % 256) / 255, 6) AS r, round((point_index * 7 % 256) / 255, 6) AS g, round((point_index * 11 % 256) / 255, 6) AS b FROM {V.Q}")
def e14(spark, d):
    k = F.col("point_index")
    q = V.cloud_q(spark, d).select("point_index", color.pack_rgb(k % 256, k * 7 % 256, k * 11 % 256).alias("packed"))
    return _round(q.select("point_index", "packed", *[c.alias(n) for c, n in zip(color.unpack_rgb(F.col("packed")), "rgb")]))


@query("e15_hsl", f"SELECT ix, iy, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round((greatest(r, g, b) + least(r, g, b)) / 2, 6) AS l FROM {V.PIXELS}")
def e15(spark, d):
    p = V.pixels(spark, d)
    hsl = color.rgb_to_hsl((F.col("r"), F.col("g"), F.col("b")))
    p = p.select("ix", "iy", *[c.alias(n) for c, n in zip(hsl, ("h", "s", "l"))])
    return _round(p.select("ix", "iy", *[c.alias(n) for c, n in zip(color.hsl_to_rgb((F.col("h"), F.col("s"), F.col("l"))), "rgb")], "l"))


_TINTED = "(l + (1 - abs(2 * l - 1)) * 0.8 * {})"


@query("e16_colourise", "SELECT ix, iy, " + ", ".join(f"round({n} + ({_TINTED.format(k)} - {n}) * 0.5, 6) AS {n}" for n, k in (("r", 0.5), ("g", -0.125), ("b", -0.5))) + f" FROM (SELECT *, (greatest(r, g, b) + least(r, g, b)) / 2 AS l FROM {V.PIXELS})")
def e16(spark, d):
    p = V.pixels(spark, d)
    rgb = color.colourise((F.col("r"), F.col("g"), F.col("b")), (F.lit(0.9), F.lit(0.4), F.lit(0.1)), 0.5)
    return _round(p.select("ix", "iy", *[c.alias(n) for c, n in zip(rgb, "rgb")]))


_SRGB = lambda c: f"floor(CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow({c}, 1 / 2.4::double) - 0.055 END * 255 + 0.5)::int AS {c}"


@query("e18_srgb_bytes", f"SELECT ix, iy, {', '.join(_SRGB(c) for c in 'rgb')}, floor(alpha * 255 + 0.5)::int AS alpha FROM {V.PIXELS}")
def e18(spark, d):
    return raster.display_bytes(V.pixels(spark, d)).select("ix", "iy", "r", "g", "b", "alpha")


_SIG = "1 / (1 + exp(-least(greatest(opacity, -32), 32)))"


@query("e20_splat_decode", f"SELECT point_index, round({_SIG}, 6) AS opacity, round(exp(least(greatest(scale[1], -16), 16)), 6) AS scale_x, round(rot[1] / sqrt(list_sum(list_transform(rot, lambda v: v * v))), 6) AS rot_w FROM {V.SPLATS}")
def e20(spark, d):
    s = splats.decode(V.splats(spark, d))
    return _round(s.select("point_index", "opacity", F.col("scale")[0].alias("scale_x"), F.col("rot")[0].alias("rot_w")))


_M = [2.0, 0, 0, 10, 0, 3.0, 0, -5, 0, 0, 4.0, 2, 0, 0, 0, 1]


@query("e23_affine", f"SELECT point_index, round(2 * x + 10, 6) AS x, round(3 * y - 5, 6) AS y, round(4 * z + 2, 6) AS z FROM {V.SPLATS}")
def e23(spark, d):
    return _round(splats.to_world(V.splats(spark, d), _M).select("point_index", "x", "y", "z"))


@query("e25_project", f"SELECT point_index, round((x - 25) / 30 * 0.5 * 640 + 320, 6) AS px, round((y - 950) / 30 * 0.5 * 480 + 240, 6) AS py FROM {V.Q}")
def e25(spark, d):
    px, py = S.to_pixel(S.clip(S.vec("x", "y", "z"), camera.orthographic(25.0, 950.0, 30.0)), 640, 480)
    return _round(V.cloud_q(spark, d).select("point_index", px.alias("px"), py.alias("py")))


# Second derivatives of the natural spline through (0, 0), (2, 3), (5, -1), (9.9, 4), by Cramer's rule on its two equations.
_M1, _M2 = (-17 * 15.8 - 3 * 6 * (5 / 4.9 + 4 / 3)) / 149, (10 * 6 * (5 / 4.9 + 4 / 3) + 3 * 17) / 149


def _piece(t0, t1, y0, y1, m0, m1):
    h = t1 - t0
    return f"{y0} + (t - {t0}) * ({(y1 - y0) / h - h * (2 * m0 + m1) / 6!r}::double + (t - {t0}) * ({m0 / 2!r}::double + (t - {t0}) * {(m1 - m0) / (6 * h)!r}::double))"


@query("e29_natural_spline", f"SELECT point_index, round(CASE WHEN t < 2 THEN {_piece(0, 2, 0, 3, 0, _M1)} WHEN t < 5 THEN {_piece(2, 5, 3, -1, _M1, _M2)} ELSE {_piece(5, 9.9, -1, 4, _M2, 0)} END, 6) AS s FROM (SELECT point_index, least((point_index % 100) / 10::double, 9.9) AS t FROM {V.Q})")
def e29(spark, d):
    t = (F.col("point_index") % 100) / 10
    return _round(V.cloud_q(spark, d).select("point_index", S.clamp(timeseries.spline_column(t, [0, 2, 5, 9.9], [0, 3, -1, 4]), -10, 10).alias("s")))


@query("e34_slerp", f"SELECT point_index, round(sin({_T} * pi() / 4), 6) AS z, round(cos({_T} * pi() / 4), 6) AS w FROM {V.Q}")
def e34(spark, d):
    import math

    t = (F.col("point_index") * 37 % 1000) / 999
    q = timeseries.slerp([F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)], [F.lit(0.0), F.lit(0.0), F.lit(math.sqrt(0.5)), F.lit(math.sqrt(0.5))], t)
    return _round(V.cloud_q(spark, d).select("point_index", q[2].alias("z"), q[3].alias("w")))


@query("e35_fps_rescale", f"SELECT point_index, greatest((point_index * 24 + 15) // 30, 1) AS f24, greatest((point_index * 60 + 15) // 30, 1) AS f60 FROM {V.Q}")
def e35(spark, d):
    k = F.col("point_index")
    return V.cloud_q(spark, d).select("point_index", S.rescale_frames(k, 24).alias("f24"), S.rescale_frames(k, 60).alias("f60"))


@query("e38_size_scale", f"SELECT point_index, round(CASE WHEN point_index % 5 = 0 THEN 1 ELSE greatest(sqrt(x * 100 / 1920 * (point_index % 5) * 300 / 1080), 0.001) END, 6) AS s FROM {V.Q}")
def e38(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.point_size_scale(F.col("x") * 100, F.col("point_index") % 5 * 300).alias("s")))


@query("e40_file_stem", "SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' -' || p_type || '!', '[^A-Za-z0-9]+', '_', 'g'), '_+$', '') AS stem, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS key FROM part")
def e40(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", S.stem(F.concat("p_name", F.lit(" -"), "p_type", F.lit("!"))).alias("stem"), S.field_key(F.col("p_brand")).alias("key"))


@query("e44_lens", f"SELECT point_index, round(41.4214 / (16 / 9) / (2 * tan(radians(20 + x) / 2)), 6) AS focal, round(20 + x, 6) AS fov FROM {V.Q}")
def e44(spark, d):
    q = V.cloud_q(spark, d).select("point_index", S.focal_from_fov(20 + F.col("x"), 16 / 9).alias("focal"))
    return _round(q.select("point_index", "focal", S.fov_from_focal(F.col("focal"), 16 / 9).alias("fov")))


@query("e46_sh_dc_colour", f"SELECT point_index, {', '.join(f'round(greatest(0.28209479177387814 * sh[{c + 1}] + 0.5, 0), 6) AS {n}' for c, n in enumerate('rgb'))} FROM {V.SPLATS}")
def e46(spark, d):
    rgb = splats.sh_colour(F.col("sh"), (F.lit(0.0), F.lit(0.0), F.lit(1.0)), bands=1)
    return _round(V.splats(spark, d).select("point_index", *[c.alias(n) for c, n in zip(rgb, "rgb")]))


def _sh_sql(c):
    # along +z only the harmonics without x and y remain
    import math

    b = {2: splats.C1, 6: splats.C2[2] * 2, 12: splats.C3[3] * 2}
    terms = " + ".join(f"{v!r}::double * sh[{3 + 15 * c + k}]" for k, v in b.items())
    assert math.isfinite(sum(b.values()))
    return f"round(greatest({splats.C0!r}::double * sh[{c + 1}] + {terms} + 0.5, 0), 6)"


@query("e46_sh_degree3", f"SELECT point_index, {', '.join(f'{_sh_sql(c)} AS {n}' for c, n in enumerate('rgb'))} FROM {V.SPLATS}")
def e46_3(spark, d):
    rgb = splats.sh_colour(F.col("sh"), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return _round(V.splats(spark, d).select("point_index", *[c.alias(n) for c, n in zip(rgb, "rgb")]))


@query("e48_hash", f"SELECT o_orderkey, ({S.hash32_sql('o_orderkey')} & 16777215) / 16777215.0::double AS h FROM orders")
def e48(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", S.hash_unit(F.col("o_orderkey")).alias("h"))


_RH = "xor(xor((o_custkey::hugeint * 747796405 % 4294967296)::bigint, (o_orderkey::hugeint * 2891336453 % 4294967296)::bigint), (3::hugeint * 277803737 % 4294967296)::bigint)"


@query("e49_region_hash", f"SELECT o_orderkey, {_RH} AS k, ({S.hash32_sql(_RH)} & 16777215) / 16777215.0::double AS h FROM orders")
def e49(spark, d):
    k = S.region_hash(F.col("o_custkey"), F.col("o_orderkey"), F.lit(3))
    return V.table(spark, d, "orders").select("o_orderkey", k.alias("k"), S.hash_unit(k).alias("h"))


@query("e54_wave", f"SELECT point_index, round(pow(0.5 + 0.5 * cos(2 * pi() * x / 7), 3), 6) AS peak, round(1 - (lambda t: t * t * (3 - 2 * t))(least(greatest(abs(x - 25) / 10, 0), 1)), 6) AS line FROM {V.Q}".replace("(lambda t: t * t * (3 - 2 * t))(least(greatest(abs(x - 25) / 10, 0), 1))", "pow(least(abs(x - 25) / 10, 1), 2) * (3 - 2 * least(abs(x - 25) / 10, 1))"))
def e54(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.wave_peak(F.col("x") / 7, 3.0).alias("peak"), S.line(F.col("x") - 25, 10.0).alias("line")))


@query("e66_ripples", f"SELECT point_index, round(pow(0.5 + 0.5 * cos(2 * pi() * (x / 0.16 - 0.125)), 4), 6) AS linear, round(pow(0.5 + 0.5 * cos(2 * pi() * (sqrt(x * x + y * y) / 0.16 - 0.125)), 6), 6) AS radial FROM {V.FLAT_Q}")
def e66(spark, d):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return _round(V.flat_q(spark, d).select("point_index", S.linear_ripple(F.col("x"), 0.16, F.lit(0.125)).alias("linear"), S.radial_ripple(r, 0.16, F.lit(0.125)).alias("radial")))


@query("e56_patterns")
def e56(spark, d):
    q = V.flat_q(spark, d)
    return _round(q.select("point_index", *[patterns.pattern_column(patterns.DEFAULTS[k], F.col("x"), F.col("y"), 0.5, 7).alias(k) for k in patterns.TYPES]))


@query("e78_falloff", f"SELECT ix, iy, (CASE WHEN r <= 1 THEN 1 ELSE 0 END)::double AS hard, round(1 - pow(r, 2) * (3 - 2 * r), 6) AS soft, round(exp(-4 * r * r), 6) AS gaussian FROM {V.PIXELS}")
def e78(spark, d):
    return _round(V.pixels(spark, d).select("ix", "iy", *[S.falloff(F.col("r"), p).alias(p) for p in ("hard", "soft", "gaussian")]))


_O = "(least(1, 8 * alpha) + 0.01)"


@query("e79_oit_weight", f"SELECT ix, iy, round(least(greatest(0.5 * pow({_O}, 3) + 128 * pow({_O}, 3) * pow(1 - depth / 10, 4), 0.001), 256), 6) AS w FROM {V.PIXELS}")
def e79(spark, d):
    return _round(V.pixels(spark, d).select("ix", "iy", S.oit_weight(F.col("alpha"), F.col("depth") / 10).alias("w")))


@query("e84_particle_travel", f"SELECT point_index, round((x / 50 + 2.5 * y / 900 * 0.12 + 1) % 1, 6) AS travel FROM {V.Q}")
def e84(spark, d):
    return _round(V.cloud_q(spark, d).select("point_index", S.particle_travel(F.col("x") / 50, 2.5, F.col("y") / 900).alias("travel")))


_PH = "(x / 50 + 2.5 * 0.7 / (y / 100) - z / 97 * 1.5 / (y / 100))"


@query("e85_stream_phase", f"SELECT point_index, round({_PH} - floor({_PH}), 6) AS phase FROM {V.Q}")
def e85(spark, d):
    c = F.col
    return _round(V.cloud_q(spark, d).select("point_index", S.stream_phase(c("x") / 50, F.lit(0.0), 2.5, F.lit(0.7), c("y") / 100, c("z") / 97, F.lit(1.5)).alias("phase")))


@query("src25_frame_paths", f"SELECT point_index, format('frame_{{:06d}}.exr', point_index + 1) AS path FROM {V.Q}")
def src25(spark, d):
    return V.cloud_q(spark, d).select("point_index", S.frame_path(F.col("point_index")).alias("path"))


# Joins

_PAIRS = f"FROM {V.FLAT_Q} l JOIN {V.FLAT_Q} r ON pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2) <= pow(0.03, 2) AND l.point_index <> r.point_index"


@query("j6_neighbour_counts", f"SELECT l.point_index, count(*) AS n {_PAIRS} GROUP BY 1")
def j6(spark, d):
    q = V.flat_q(spark, d).select("point_index", "x", "y", "z")
    return spatial.neighbour_counts(q, 0.03)


_SUP = "(SELECT s_suppkey AS query_id, (s_suppkey * 7 % 100) / 100 AS x, (s_suppkey * 13 % 100) / 100 AS y, 0.05::double AS z FROM supplier)"
_D2 = "pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)"


def _suppliers(spark, d):
    k = F.col("s_suppkey")
    return V.table(spark, d, "supplier").select(k.alias("query_id"), (k * 7 % 100 / 100).alias("x"), (k * 13 % 100 / 100).alias("y"), F.lit(0.05).alias("z"))


@query("j7_nearest_point", f"SELECT query_id, point_index, round(d2, 9) AS d2 FROM (SELECT query_id, point_index, {_D2} AS d2 FROM {V.FLAT_Q} p, {_SUP} q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_index) = 1")
def j7(spark, d):
    return _round(spatial.nearest(_suppliers(spark, d), V.flat_q(spark, d), 0.02), 9)


@query("j9_nearest_within", f"SELECT query_id, point_index FROM (SELECT query_id, point_index, {_D2} AS d2 FROM {V.FLAT_Q} p, {_SUP} q WHERE {_D2} < 0.0009) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_index) = 1")
def j9(spark, d):
    return spatial.nearest(_suppliers(spark, d), V.flat_q(spark, d), 0.03, fallback=False, strict=True).select("query_id", "point_index")


def _support(spark, d):
    return V.flat_q(spark, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "confidence": F.col("point_index") % 10 / 10})


@query(
    "j8_ranked_downhill",
    f"""WITH e AS (SELECT l.point_index AS point_index, r.point_index AS other, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2)) AS dist, l.z - r.z AS drop_, (r.point_index % 10) / 10 AS conf {_PAIRS}),
    s AS (SELECT point_index, other, drop_, dist, 3.2 * drop_ / greatest(dist, 0.02) + 1.9 * drop_ / greatest(dist, 1e-9) + 1.6 * conf + 0.55 - greatest(dist - 0.02, 0) / 0.02 * 0.5 - greatest(-drop_, 0) / greatest(dist, 0.02) + 0.22 * 0.3 AS score FROM e)
    SELECT point_index, other, row_number() OVER (PARTITION BY point_index ORDER BY round(score, 6) DESC, other) AS rank FROM s WHERE drop_ > -0.08 * 0.02 OR score > 0""",
)
def j8(spark, d):
    out = spatial.ranked_neighbours(_support(spark, d), 0.03, bridge=0.02, branching=0.3, tolerance=0.5)
    return out.select("point_index", "other", "rank")


@query(
    "j10_next_node",
    f"""WITH e AS (SELECT l.point_index AS point_index, r.point_index AS next, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2)) AS dist, r.x - l.x AS dx, (r.point_index % 10) / 10 AS conf {_PAIRS}),
    s AS (SELECT point_index, next, round(dx / greatest(dist, 1e-9), 12) AS align, round(2 * dx / greatest(dist, 1e-9) + 0.35 * conf - dist / 0.03, 6) AS score FROM e)
    SELECT point_index, max(score) AS score FROM s WHERE align >= -0.15 GROUP BY 1""",
)
def j10(spark, d):
    n = V.flat_q(spark, d).withColumns({"dx": F.lit(1.0), "dy": F.lit(0.0), "dz": F.lit(0.0), "confidence": F.col("point_index") % 10 / 10})
    return _round(spatial.next_field_node(n, 0.03).select("point_index", "score"))


@query(
    "j11_effect_match",
    f"""WITH e AS (SELECT s_suppkey AS effect_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 ELSE -1 END AS src, (s_suppkey * 7 % 100) / 100 AS x, (s_suppkey * 13 % 100) / 100 AS y, 0.05::double AS z FROM supplier),
    n AS (SELECT effect_id, point_index FROM (SELECT effect_id, point_index, {_D2} AS d2 FROM {V.FLAT_Q} p, e q WHERE src < 0) WHERE d2 <= 0.06 * 0.06 QUALIFY row_number() OVER (PARTITION BY effect_id ORDER BY d2, point_index) = 1)
    SELECT effect_id, point_index FROM n UNION ALL SELECT effect_id, p_partkey FROM e JOIN part ON p_partkey = src""",
)
def j11(spark, d):
    k = F.col("query_id")
    e = _suppliers(spark, d).select(k.alias("effect_id"), F.when(k % 2 == 0, k * 3).otherwise(-1).alias("source_point_index"), "x", "y", "z")
    return spatial.match_effects(e, V.flat_q(spark, d))


@query("j14_proximity_exclusion", f"SELECT point_index FROM {V.FLAT_Q} p WHERE NOT EXISTS (SELECT 1 FROM {_SUP} q WHERE {_D2} <= 0.0025)")
def j14(spark, d):
    c = V.flat_q(spark, d).withColumn("candidate_id", F.col("point_index"))
    return spatial.exclude_near(c, _suppliers(spark, d), 0.05).select("point_index")


@query(
    "j16_surface_lookup",
    f"""WITH c AS (SELECT floor(x / 0.1)::bigint AS cx, floor(y / 0.1)::bigint AS cy, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {V.FLAT_Q} GROUP BY 1, 2)
    SELECT query_id AS point_index, round(c.z, 6) AS surface_z FROM {_SUP} q JOIN c ON pow(q.x - c.x, 2) + pow(q.y - c.y, 2) <= 0.0225 AND abs(q.z - c.z) <= 0.05
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pow(q.x - c.x, 2) + pow(q.y - c.y, 2) + 4 * pow(q.z - c.z, 2), cx, cy) = 1""",
)
def j16(spark, d):
    cells = stats.surface_cells(V.flat_q(spark, d), 0.1).select("cx", "cy", "x", "y", "z")
    at = _suppliers(spark, d).withColumnRenamed("query_id", "point_index")
    return _round(spatial.surface_lookup(at, cells, 0.15, snap=0.05).select("point_index", "surface_z"))


@query("j17_self_proximity", f"SELECT l.path_id, l.seq, count(*) AS near FROM {V.PATHS} l JOIN {V.PATHS} r ON l.path_id = r.path_id AND pow(l.x - r.x, 2) + pow(l.y - r.y, 2) <= 4 AND abs(l.seq - r.seq) >= 3 AND abs(l.z - r.z) <= 1 GROUP BY 1, 2")
def j17(spark, d):
    return spatial.self_proximity(V.paths(spark, d), 2.0, apart=3, z_tolerance=1.0)


_KN = f"(SELECT path_id, seq, (seq * 10)::double AS t FROM {V.PATHS})"


@query("j12_bracket", f"WITH m AS (SELECT path_id, max(seq) AS last FROM {V.PATHS} GROUP BY 1) SELECT p.path_id, event_id AS sample_id, least(event_id * 7 % 100 // 10, last) AS segment FROM {V.PATHS} p JOIN m USING (path_id)")
def j12(spark, d):
    p = V.paths(spark, d)
    samples = p.select("path_id", F.col("event_id").alias("sample_id"), (F.col("event_id") * 7 % 100).cast("double").alias("t"))
    return spatial.bracket(samples, p.select("path_id", "seq", (F.col("seq") * 10).cast("double").alias("t"))).select("path_id", "sample_id", "segment")


@query("j1_transform_pairing", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'M' || (p_partkey % 7) END AS matrix, CASE WHEN p_partkey % 3 <> 0 THEN 'missing transform' END AS issue FROM part")
def j1(spark, d):
    k = F.col("p_partkey")
    p = V.table(spark, d, "part")
    s = p.select("p_partkey", (k % 11).cast("string").alias("dir"), F.concat(F.lit("Stem"), k.cast("string")).alias("stem"))
    m = p.where(k % 3 == 0).select((k % 11).cast("string").alias("dir"), F.concat(F.lit("STEM"), k.cast("string")).alias("stem"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("path"), (k % 7).cast("string").alias("m"))
    m = m.withColumn("matrix", F.when(F.col("path") == "b", F.concat(F.lit("M"), "m")).otherwise(F.lit("older")))
    return spatial.transform_pairing(s, m).select("p_partkey", "matrix", "issue")


_EM = "(SELECT s_suppkey AS emitter_id, s_suppkey * 3 % 50 AS link_id, CASE WHEN s_suppkey % 7 = 0 THEN 'temp' END AS temp, CASE WHEN s_suppkey % 5 = 0 THEN 'custom' END AS custom, CASE WHEN s_suppkey % 2 = 0 THEN 'saved' || s_suppkey END AS saved FROM supplier)"


def _emitters(spark, d):
    k = F.col("s_suppkey")
    return V.table(spark, d, "supplier").select(k.alias("emitter_id"), (k * 3 % 50).alias("link_id"), F.when(k % 7 == 0, "temp").alias("temp"), F.when(k % 5 == 0, "custom").alias("custom"), F.when(k % 2 == 0, F.concat(F.lit("saved"), k.cast("string"))).alias("saved"))


@query("j3_emitter_settings", f"SELECT e.emitter_id, coalesce(e.temp, e.custom, CASE WHEN e.link_id <> e.emitter_id THEN l.saved END, 'default') AS settings FROM {_EM} e LEFT JOIN {_EM} l ON l.emitter_id = e.link_id")
def j3(spark, d):
    return spatial.resolve_settings(_emitters(spark, d), F.lit("default"))


@query("j4_visible_branches", "SELECT o_orderkey AS branch_id, coalesce('s' || s_suppkey, 'default') AS settings FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey WHERE o_orderstatus <> 'F'")
def j4(spark, d):
    o = V.table(spark, d, "orders")
    e = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("emitter_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("settings"))
    b = o.select(F.col("o_orderkey").alias("branch_id"), F.col("o_custkey").alias("emitter_id"))
    return spatial.visible_branches(b, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("branch_id")), e, F.lit("default")).select("branch_id", "settings")


@query("j5_member_params", "SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN nation ON n_nationkey = l_partkey % 40")
def j5(spark, d):
    m = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("param_index"))
    return spatial.member_params(m, V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("param_index"), "n_name")).select("l_orderkey", "l_linenumber", "n_name")


@query("j19_visual_upsert", "SELECT n_name AS name, 'old' AS value FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT '  ' || upper(n_name) || ' ', 'new' FROM nation WHERE n_nationkey % 3 = 0")
def j19(spark, d):
    n = V.table(spark, d, "nation")
    new = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ")).alias("name"), F.lit("new").alias("value"))
    return spatial.upsert(n.select(F.col("n_name").alias("name"), F.lit("old").alias("value")), new, S.field_key(S.visual_name(F.col("name"))))


# Paths in time

@query("w1_path_distance", f"SELECT path_id, seq, round(d, 6) AS path_distance, round(least(1, d / 500), 6) AS accumulation, round(CASE WHEN d > 0 THEN (d * 0.37) % 1 ELSE 0 END, 6) AS phase FROM (SELECT path_id, seq, sum(step) OVER (PARTITION BY path_id ORDER BY seq) AS d FROM {_STEPS})")
def w1(spark, d):
    out = timeseries.path_distances(V.paths(spark, d), 500.0)
    return _round(out.select("path_id", "seq", "path_distance", "accumulation", "phase"))


def _smooth_sql(source, times, amount):
    for _ in range(times):
        source = f"(SELECT path_id, seq, coalesce(x + ((lag(x) OVER w + lead(x) OVER w) * 0.5 - x) * {amount}, x) AS x FROM {source} WINDOW w AS (PARTITION BY path_id ORDER BY seq))"
    return source


@query("w2_smooth_path", f"SELECT path_id, seq, round(x, 6) AS x FROM {_smooth_sql(V.PATHS, 3, 0.12 + 0.48 * 0.4)}")
def w2(spark, d):
    return _round(timeseries.smooth_paths(V.paths(spark, d), 0.4).select("path_id", "seq", "x"))


_D = "coalesce(lead({0}) OVER w, {0}) - coalesce(lag({0}) OVER w, {0})"


@query("w3_tangent", f"SELECT path_id, seq, round(CASE WHEN n > 1e-12 THEN dx / sqrt(n) ELSE 0 END, 6) + 0.0 AS tx FROM (SELECT *, dx * dx + dy * dy + dz * dz AS n FROM (SELECT path_id, seq, {_D.format('x')} AS dx, {_D.format('y')} AS dy, {_D.format('z')} AS dz FROM {V.PATHS} WINDOW w AS (PARTITION BY path_id ORDER BY seq)))")
def w3(spark, d):
    return _round(timeseries.tangents(V.paths(spark, d)).select("path_id", "seq", "tx"))


_FLOW = "(SELECT o_custkey AS layer, o_orderkey AS seq, o_orderkey // 40 AS flow_id, (o_orderkey % 4 = 0)::int AS particle_role FROM orders)"


@query("w5_flow_paths", f"WITH a AS (SELECT *, coalesce((flow_id <> lag(flow_id) OVER w)::int, 0) AS c FROM {_FLOW} WHERE particle_role = 0 WINDOW w AS (PARTITION BY layer ORDER BY seq)), n AS (SELECT *, sum(c) OVER (PARTITION BY layer ORDER BY seq)::bigint AS path_no FROM a) SELECT layer, seq, path_no FROM n QUALIFY count(*) OVER (PARTITION BY layer, path_no) >= 2")
def w5(spark, d):
    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select((F.col("o_custkey")).alias("layer"), k.alias("seq"), F.floor(k / 40).alias("flow_id"), (k % 4 == 0).cast("int").alias("particle_role"))
    return timeseries.flow_paths(rows).select("layer", "seq", "path_no")


_GAP = "coalesce(abs(x - lag(x) OVER w), 0)"


_ISLANDS = f"""WITH m AS (SELECT *, flow_blocked OR confidence < 0.175 AS gone, {_GAP} AS gap FROM {V.NODES} WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    c AS (SELECT *, coalesce(lag(gone) OVER w OR lag(bridge_blocked) OVER w OR bridge_blocked OR (gap > 0.3 AND (NOT (lag(bridge_allowed) OVER w OR bridge_allowed) OR gap > 1.2)), true)::int AS cut FROM m WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY path_id ORDER BY seq)::bigint AS island FROM c)
    SELECT path_id, event_id, island FROM i WHERE NOT gone QUALIFY count(*) OVER (PARTITION BY path_id, island) >= 2"""


@query("w6_gap_islands", _ISLANDS)
def w6(spark, d):
    return timeseries.gap_islands(V.nodes(spark, d), resolution=0.05, max_bridge=0.3).select("path_id", "event_id", "island")


@query("a27_gap_diagnostics", f"""WITH m AS (SELECT *, flow_blocked OR confidence < 0.175 AS gone, {_GAP} AS gap FROM {V.NODES} WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    j AS (SELECT *, coalesce(NOT lag(gone) OVER w, false) AND NOT gone AS joined, lag(bridge_allowed) OVER w OR bridge_allowed AS ok, lag(bridge_blocked) OVER w OR bridge_blocked AS bad FROM m WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    k AS (SELECT *, joined AND (bad OR (gap > 0.3 AND (NOT ok OR gap > 1.2))) AS rejected FROM j)
    SELECT count(*) AS nodes, sum(flow_blocked::int)::bigint AS no_flow_blocks, sum((confidence < 0.175 AND NOT flow_blocked)::int)::bigint AS low_confidence, sum((joined AND NOT rejected AND gap > 0.0625)::int)::bigint AS accepted_bridges, sum(rejected::int)::bigint AS rejected_gaps, sum((joined AND bad)::int)::bigint AS blocked_bridges,
    round(max(CASE WHEN joined AND NOT rejected AND gap > 0.0625 THEN gap END), 6) AS max_accepted, round(min(CASE WHEN rejected THEN gap END), 6) AS min_rejected FROM k""")
def a27(spark, d):
    return _round(timeseries.gap_diagnostics(V.nodes(spark, d), resolution=0.05, max_bridge=0.3))


@query("w8_prefix_sums", f"SELECT path_id, seq, round(sum(x) OVER w, 6) AS sum_x, round(sum(y) OVER w, 6) AS sum_y FROM {V.PATHS} WINDOW w AS (PARTITION BY path_id ORDER BY seq)")
def w8(spark, d):
    return _round(timeseries.prefix_sums(V.paths(spark, d), ["x", "y"]).select("path_id", "seq", "sum_x", "sum_y"))


@query("w9_timing_knots", f"SELECT path_id, seq, round(coalesce(sum(event_id % 90) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 30, 6) AS knot FROM {V.PATHS}")
def w9(spark, d):
    return _round(timeseries.timing_knots(V.paths(spark, d).withColumn("duration", F.col("event_id") % 90)).select("path_id", "seq", "knot"))


@query(
    "w10_largest_remainder",
    f"""WITH w AS (SELECT path_id, seq, (event_id % 13)::double AS weight, count(*) OVER (PARTITION BY path_id) AS n, sum(event_id % 13) OVER (PARTITION BY path_id) AS whole FROM {V.PATHS}),
    i AS (SELECT *, greatest(500, n) - n AS rest, round((greatest(500, n) - n) * CASE WHEN whole > 0 THEN weight / whole ELSE 1 / n END, 9) AS ideal FROM w),
    p AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY ideal - floor(ideal) DESC, seq) AS place, rest - sum(floor(ideal)) OVER (PARTITION BY path_id) AS extra FROM i)
    SELECT path_id, seq, (1 + floor(ideal) + (place <= extra)::int)::bigint AS frames FROM p""",
)
def w10(spark, d):
    return timeseries.apportion(V.paths(spark, d).withColumn("weight", (F.col("event_id") % 13).cast("double")), 500).select("path_id", "seq", "frames")


@query("w11_frame_range", f"SELECT point_index AS frame FROM {V.Q} WHERE point_index BETWEEN 10 AND 120")
def w11(spark, d):
    return timeseries.slice_frames(V.cloud_q(spark, d).select(F.col("point_index").alias("frame")), 10, 120)


@query(
    "w12_unique_ids",
    """WITH r AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 = 0 THEN 'key' || (p_partkey // 2 + 1) END AS id FROM part),
    f AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM range(1, 200000) t(n) WHERE n <= (SELECT count(*) FROM part) AND 'key' || n NOT IN (SELECT id FROM r WHERE id IS NOT NULL)),
    m AS (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM r WHERE id IS NULL)
    SELECT seq, id FROM r WHERE id IS NOT NULL UNION ALL SELECT seq, 'key' || n FROM m JOIN f USING (k)""",
)
def w12(spark, d):
    k = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(k.alias("seq"), F.when(k % 4 == 0, F.concat(F.lit("key"), (F.floor(k / 2) + 1).cast("string"))).alias("id"))
    return timeseries.fill_ids(rows, "key")


@query("e33_segment_weights", f"SELECT path_id, seq, round(sqrt(pow(nx - x, 2) + pow(ny - y, 2)) + 0.25 * abs(nz - z), 6) AS weight FROM (SELECT path_id, seq, x, y, z, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM {V.PATHS} WINDOW w AS (PARTITION BY path_id ORDER BY seq)) WHERE nx IS NOT NULL")
def e33(spark, d):
    p = V.paths(spark, d).select("path_id", "seq", "x", "y", F.lit(0.0).alias("z"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"), F.col("z").alias("tz"), *[F.lit(v).alias(c) for c, v in (("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))])
    return _round(timeseries.segment_weights(p).select("path_id", "seq", "weight"))


@query("e36_still_sequence", f"SELECT point_index, i::int AS frame FROM {V.Q}, range(60) r(i)")
def e36(spark, d):
    return timeseries.still_frames(V.cloud_q(spark, d).select("point_index"), 2.5, 24)


@query("e37_camera_sequence", f"WITH s AS (SELECT path_id, seq, 1 + event_id % 5 AS frames, coalesce(sum(1 + event_id % 5) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS b, lead(seq) OVER (PARTITION BY path_id ORDER BY seq) IS NULL AS last FROM {V.PATHS}) SELECT path_id, seq, b + i AS frame, round(i / frames, 6) AS t FROM s, range(6) r(i) WHERE i < frames + last::int")
def e37(spark, d):
    p = V.paths(spark, d).select("path_id", "seq", (1 + F.col("event_id") % 5).alias("frames"))
    return _round(timeseries.expand_frames(p).select("path_id", "seq", "frame", "t"))


@query("g24_camera_keys", f"SELECT path_id, event_id, seq + 1 AS key_id FROM {V.PATHS}")
def g24(spark, d):
    return timeseries.camera_keys(V.paths(spark, d)).select("path_id", "event_id", "key_id")


@query("src28_import_durations", f"SELECT path_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY path_id ORDER BY event_id) - event_id, 0) AS duration FROM {V.PATHS}")
def src28(spark, d):
    p = V.paths(spark, d).select("path_id", "event_id", F.col("event_id").alias("frame"))
    return timeseries.import_durations(p).select("path_id", "event_id", "duration")


@query("a11_motion_stats")
def a11(spark, d):
    keys = [{"knot": 0.0, "x": 0.0, "y": 0.0, "z": 0.0, "tx": 0.0, "ty": 1.0, "tz": 0.0}, {"knot": 1.0, "x": 1.0, "y": 0.0, "z": 0.0, "tx": 0.0, "ty": 1.0, "tz": 0.0}, {"knot": 3.0, "x": 1.0, "y": 2.0, "z": 1.0, "tx": 1.0, "ty": 1.0, "tz": 0.0}]
    return _round(timeseries.motion_stats(spark, keys))


# Composition

_FX = "(SELECT l_partkey AS point_index, l_discount * 5 AS value, l_tax AS emission, l_discount AS opacity, l_quantity / 100 AS size FROM lineitem)"


def _effects(spark, d):
    return V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("point_index"), (F.col("l_discount") * 5).alias("value"), F.col("l_tax").alias("emission"), F.col("l_discount").alias("opacity"), (F.col("l_quantity") / 100).alias("size"))


@query("a19_compose_add", f"SELECT point_index, round(least(1, sum(least(value, 1))), 6) AS value, round(sum(emission), 6) AS emission, round(sum(opacity), 6) AS opacity, round(sum(size), 6) AS size FROM {_FX} WHERE value > 1e-6 GROUP BY 1")
def a19_add(spark, d):
    return _round(compose.compose_uniform(_effects(spark, d), "add"))


@query("a19_compose_max", f"SELECT point_index, max(least(value, 1)) AS value, max(emission) AS emission, max(opacity) AS opacity, max(size) AS size FROM {_FX} WHERE value > 1e-6 GROUP BY 1")
def a19_max(spark, d):
    return compose.compose_uniform(_effects(spark, d), "max")


@query("a19_compose_screen", f"SELECT point_index, round(1 - product(1 - least(value, 1)), 6) AS value, round(1 - product(1 - emission), 6) AS emission, round(1 - product(1 - opacity), 6) AS opacity, round(1 - product(1 - size), 6) AS size FROM {_FX} WHERE value > 1e-6 GROUP BY 1")
def a19_screen(spark, d):
    return _round(compose.compose_uniform(_effects(spark, d), "screen"))


def _ordered(spark, d):
    li = V.table(spark, d, "lineitem")
    mode = F.element_at(F.array(*[F.lit(m) for m in compose.MODES]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    extra = {"order": F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), "mode": mode, "opacity_mul": 1 + F.col("l_tax"), "size_mul": 1 - F.col("l_discount"), "mix": F.col("l_discount"), "red": F.col("l_tax") * 10, "green": F.lit(0.5), "blue": F.lit(0.2), "point_index": F.col("l_partkey"), "value": F.col("l_discount") * 5, "emission": F.col("l_tax"), "opacity": F.col("l_discount"), "size": F.col("l_quantity") / 100}
    return li.select(*[c.alias(n) for n, c in extra.items()])


def _case(**by_mode) -> str:
    return "CASE e.mode " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in by_mode.items()) + " END"


def _fold_sql(members: bool) -> str:
    """The fold of each point's effects in order, one effect of every point a round."""
    c = lambda x: f"least(greatest({x}, 0), 1)"
    screened = lambda a, b: f"1 - (1 - {c(a)}) * (1 - {c(b)})"
    step = {"value": _case(add=c("s.value + e.value"), max="greatest(s.value, e.value)", multiply="greatest(s.value, e.value)", screen=screened("s.value", "e.value"), override="e.value")}
    for n in ("emission", "opacity", "size"):
        step[n] = _case(add=f"s.{n} + e.{n}", max=f"greatest(s.{n}, e.{n})", multiply=f"s.{n} + e.{n}", screen=screened(f"s.{n}", f"e.{n}"), override=f"e.{n}")
    for n in ("opacity_mul", "size_mul"):
        step[n] = _case(add=f"s.{n} * e.{n}", max=f"greatest(s.{n}, e.{n})", multiply=f"s.{n} * e.{n}", screen=f"s.{n} * e.{n}", override=f"e.{n}")
    step["mix"] = _case(add=c("s.mix + e.mix"), max="greatest(s.mix, e.mix)", multiply=c("s.mix + e.mix"), screen=screened("s.mix", "e.mix"), override="e.mix")
    tints = "e.mode IN ('add', 'multiply', 'screen') AND e.mix > 1e-6"
    for n in ("red", "green", "blue"):
        taken = f"CASE WHEN e.mode = 'override' OR (e.mode = 'max' AND e.mix >= s.mix) THEN e.{n} ELSE s.{n} END"
        share = c(f"CASE WHEN {step['mix']} > 1e-6 THEN e.mix / ({step['mix']}) ELSE 0 END")
        step[n] = f"CASE WHEN e.mode IN ('add', 'multiply', 'screen') THEN s.{n} + (e.{n} - s.{n}) * {share} ELSE {taken} END" if members else taken
        step[f"sum_{n}"] = f"CASE WHEN {tints} THEN s.sum_{n} + e.{n} * {c('e.mix')} ELSE s.sum_{n} END"
    step["weight"] = f"CASE WHEN e.mode = 'override' THEN 0 WHEN {tints} THEN s.weight + {c('e.mix')} ELSE s.weight END"
    first = ", ".join(f"{1 if n.endswith('_mul') else 0}::double AS {n}" for n in step)
    out = [f"round({n}, 6) + 0.0 AS {n}" for n in ("value", "emission", "opacity", "size")]
    out += [f"round({n if members else f'greatest({n}, 0)'}, 6) + 0.0 AS {n}" for n in ("opacity_mul", "size_mul")] + ["round(mix, 6) + 0.0 AS mix"]
    out += [f"round({n if members else f'CASE WHEN weight > 1e-6 THEN sum_{n} / weight ELSE {n} END'}, 6) + 0.0 AS {n}" for n in ("red", "green", "blue")]
    return f"""WITH RECURSIVE e AS (SELECT l_partkey AS point_index, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, mode, value, emission, opacity, size) AS k, * FROM (
        SELECT *, ['add', 'max', 'multiply', 'screen', 'override'][l_linenumber % 5 + 1] AS mode, {c('l_discount * 5')} AS value, l_tax AS emission, l_discount AS opacity, l_quantity / 100 AS size, 1 + l_tax AS opacity_mul, 1 - l_discount AS size_mul, l_discount AS mix, l_tax * 10 AS red, 0.5::double AS green, 0.2::double AS blue FROM lineitem) WHERE value > 1e-6),
      s AS (SELECT DISTINCT point_index, 0::bigint AS k, {first} FROM e UNION ALL SELECT s.point_index, s.k + 1, {', '.join(f'({x})::double' for x in step.values())} FROM s JOIN e ON e.point_index = s.point_index AND e.k = s.k + 1)
      SELECT point_index, {', '.join(out)} FROM s QUALIFY row_number() OVER (PARTITION BY point_index ORDER BY k DESC) = 1"""


@query("a19_compose_ordered", _fold_sql(False))
def a19(spark, d):
    return _round(compose.compose(_ordered(spark, d)))


@query("a20_compose_members", _fold_sql(True))
def a20(spark, d):
    return _round(compose.compose_members(_ordered(spark, d)))


@query("e68_runtime_contribution", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(1, pow(0.5 + 0.5 * cos(2 * pi() * (l_quantity / 7 - (0.25 - 1.5 * n_nationkey / 100))), 4) * 0.8 * l_discount * 10), 6) AS value FROM lineitem JOIN nation ON n_nationkey = l_partkey % 40")
def e68(spark, d):
    m = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_discount") * 10).alias("edge_weight"), (F.col("l_partkey") % 40).alias("param_index"))
    p = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("param_index"), F.lit(0.8).alias("intensity"), F.lit(0.25).alias("phase"), (F.col("n_nationkey") / 100).alias("speed"), F.lit("linear").alias("pattern"), *[F.lit(1.0).alias(f"{c}_response") for c in ("emission", "opacity", "size", "mix")])
    wave = S.wave_peak(F.col("l_quantity") / 7 - F.col("phase_t"), 4.0)
    return _round(compose.contribute(m, p, 1.5, wave).select("l_orderkey", "l_linenumber", "l_partkey", "value"))


# Pictures

@query("a16_depth_test", f"SELECT ix, iy, point_index, round(depth, 9) AS depth, round(r, 9) AS r FROM {V.FRAGMENTS} QUALIFY row_number() OVER (PARTITION BY ix, iy ORDER BY depth, layer, point_index) = 1")
def a16(spark, d):
    return _round(raster.depth_test(V.fragments(spark, d)).select("ix", "iy", "point_index", "depth", "r"), 9)


@query("a17_depth_prepass", f"SELECT ix, iy, round(min(CASE WHEN alpha >= 0.5 THEN depth END), 9) AS scene_depth FROM {V.FRAGMENTS} GROUP BY 1, 2")
def a17(spark, d):
    return _round(raster.depth_prepass(V.fragments(spark, d)), 9)


_OA = "(least(1, 8 * alpha) + 0.01)"
_WA = f"least(greatest(0.5 * pow({_OA}, 3) + 128 * pow({_OA}, 3) * pow(1 - least(greatest((depth - 1) / 9, 0), 1), 4), 0.001), 256) * alpha"


@query("a18_oit_composite", f"SELECT ix, iy, {', '.join(f'round(sum({c} * w) / greatest(sum(w), 1e-6) * (1 - product(1 - alpha)), 9) AS {c}' for c in 'rgb')}, round(1 - product(1 - alpha), 9) AS alpha, round(min(depth), 9) AS depth FROM (SELECT *, {_WA} AS w FROM {V.FRAGMENTS}) GROUP BY 1, 2")
def a18(spark, d):
    return _round(raster.composite(raster.accumulate(V.fragments(spark, d), near=1.0, far=10.0)), 9)


@query("r11_blend_over")
def r11(spark, d):
    return _round(raster.blend_over(V.fragments(spark, d)))


@query("a22_fill_sparse", f"""WITH g AS (SELECT c.ix, c.iy, c.r, c.alpha, sum(n.alpha / (1 + sqrt(pow(c.ix - n.ix, 2) + pow(c.iy - n.iy, 2)))) AS w, sum(n.r * n.alpha / (1 + sqrt(pow(c.ix - n.ix, 2) + pow(c.iy - n.iy, 2)))) AS s FROM p c JOIN p n ON abs(c.ix - n.ix) <= 1 AND abs(c.iy - n.iy) <= 1 AND n.alpha > 0.3 AND (c.alpha <= 0.3 OR abs(c.depth - n.depth) <= greatest(0.05, 0.02 * greatest(c.depth, n.depth))) GROUP BY ALL)
    SELECT ix, iy, round(CASE WHEN alpha <= 0.3 AND w > 1e-6 THEN s / w ELSE r END, 6) AS r, alpha FROM p LEFT JOIN g USING (ix, iy, r, alpha)""".replace("p c JOIN p n", f"{V.PIXELS} c JOIN {V.PIXELS} n").replace("FROM p LEFT", f"FROM {V.PIXELS} LEFT"))
def a22(spark, d):
    return _round(raster.fill_sparse(V.pixels(spark, d), threshold=0.3).select("ix", "iy", "r", "alpha"))


_RINGS = "(SELECT dx, dy, ring FROM (VALUES (1, 1.0), (2, 0.5)) k(rad, ring), LATERAL (SELECT a * rad AS dx, b * rad AS dy FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) WHERE a <> 0 OR b <> 0))"


@query("a23_eye_dome", f"""WITH s AS (SELECT c.ix, c.iy, sum(greatest(log2(n.depth) - log2(c.depth), 0) * o.ring::double) AS rise, count(*) AS k FROM {V.PIXELS} c, {_RINGS} o JOIN {V.PIXELS} n ON n.ix = c.ix + o.dx AND n.iy = c.iy + o.dy GROUP BY 1, 2)
    SELECT p.ix, p.iy, round(CASE WHEN coalesce(rise, 0) > 1e-6 THEN least(greatest(exp(-0.8::double * rise / k), 0.35), 1) ELSE 1 END, 6) AS shade FROM {V.PIXELS} p LEFT JOIN s USING (ix, iy)""")
def a23(spark, d):
    return _round(raster.eye_dome(V.pixels(spark, d), thickness=1.5, strength=0.8).select("ix", "iy", "shade"))


@query("a24_downsample", f"SELECT (ix // 2)::int AS ix, (iy // 2)::int AS iy, round(CASE WHEN sum(alpha) > 1e-6 THEN sum(r * alpha) / sum(alpha) ELSE 0 END, 6) AS r, round(sum(alpha) / 4, 6) AS alpha, round(sum(depth * greatest(alpha, 0.001)) / sum(greatest(alpha, 0.001)), 6) AS depth FROM {V.PIXELS} GROUP BY 1, 2")
def a24(spark, d):
    p = V.pixels(spark, d)
    half = (p.agg(F.max("iy")).first()[0] or 0) // 2 + 1
    return _round(raster.downsample(p, 64, 2 * half, 32, half).select("ix", "iy", "r", "alpha", "depth"))


@query("r6_fast_render")
def r6(spark, d):
    q = V.flat_q(spark, d).withColumns({"layer": F.lit(0), "r": F.col("x"), "g": F.col("y"), "b": F.lit(0.5)})
    vp = camera.view_projection(camera.Camera((0.5, -1.5, 1.0), (0.5, 0.5, 0.0)), 160, 90)
    return _round(raster.render(q, vp, 160, 90, radius=1.5, mode="fast"))


@query("r7_beauty_render")
def r7(spark, d):
    q = V.flat_q(spark, d).withColumns({"layer": F.lit(0), "r": F.col("x"), "g": F.col("y"), "b": F.lit(0.5)})
    vp = camera.view_projection(camera.Camera((0.5, -1.5, 1.0), (0.5, 0.5, 0.0)), 160, 90)
    return _round(raster.render(q, vp, 160, 90, radius=2.5, alpha=0.6, profile="soft", xray={"front": 1.0, "hidden": 0.3, "decay": 2.0}), 5)


@query("r10_splat_footprint")
def r10(spark, d):
    s = splats.decode(V.splats(spark, d))
    view = camera.view(camera.Camera((0.0, -5.0, 1.0))).ravel().tolist()
    return _round(splats.footprint(s, view, 500.0).select("point_index", "view_depth", "radius_major", "radius_minor"), 4)


# Path building

def _bake_inputs(spark, d):
    q = V.flat_q(spark, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    bake = paths.Bake(voxel=0.02, bridge=0.05, radius=0.06, length=0.5, steps=24, branches=4)
    support = paths.support_graph(q, q.count(), bake)
    e = _suppliers(spark, d).withColumnRenamed("query_id", "emitter_id")
    return support, e, bake


@query("g1_support_graph", f"SELECT point_index, round(0.9::double, 6) AS confidence, floor(x / 0.05)::bigint AS cx, floor(y / 0.05)::bigint AS cy, floor(z / 0.05)::bigint AS cz FROM {V.FLAT_Q}")
def g1(spark, d):
    support, _, _ = _bake_inputs(spark, d)
    return _round(support.select("point_index", "confidence", "cx", "cy", "cz"))


@query("g5_trace_branches")
def g5(spark, d):
    support, e, bake = _bake_inputs(spark, d)
    return _round(paths.trace(e, support, bake))


@query("g6_suggest_emitters")
def g6(spark, d):
    support, e, _ = _bake_inputs(spark, d)
    found = paths.suggest_emitters(support, e, radius=0.06)
    return spark.createDataFrame([(float(f[0]), int(f[4])) for f in found] or [], "score double, point_index long")


@query("g7_snap_emitters", f"SELECT query_id AS emitter_id, point_index AS start FROM (SELECT query_id, point_index, {_D2} AS d2 FROM {V.FLAT_Q} p, {_SUP} q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_index) = 1")
def g7(spark, d):
    support, e, bake = _bake_inputs(spark, d)
    return paths.snap_emitters(e, support, bake.radius)


@query(
    "g8_resample",
    f"""WITH m AS (SELECT path_id, seq, x, sum(step) OVER w AS d FROM {_STEPS} WINDOW w AS (PARTITION BY path_id ORDER BY seq)), s AS (SELECT *, lead(x) OVER w AS bx, lead(d) OVER w AS bd FROM m WINDOW w AS (PARTITION BY path_id ORDER BY seq))
    SELECT path_id, round(k * 25.0::double, 6) AS distance, round(x + (bx - x) * (k * 25 - d) / greatest(bd - d, 1e-12), 5) AS x FROM s, range(3000) r(k) WHERE bx IS NOT NULL AND k >= ceil(d / 25 - 1e-9) AND k < ceil(bd / 25 - 1e-9)
    UNION ALL SELECT path_id, round(d, 6), round(x, 5) FROM s WHERE bx IS NULL""",
)
def g8(spark, d):
    out = paths.resample(V.paths(spark, d), 25.0).select("path_id", "distance", "x")
    return _round(_round(out, 6, ["distance"]), 5, ["x"])


@query("g8_spline_points")
def g8_spline(spark, d):
    return _round(paths.spline_points(V.paths(spark, d), 3))


@query("g9_knot_scores")
def g9(spark, d):
    return _round(paths.knot_scores(V.paths(spark, d), 2.0).select("path_id", "seq", "knot"))


@query("g11_simplify")
def g11(spark, d):
    p = V.paths(spark, d).withColumn("knot", F.lit(0.1))
    return paths.simplify(p, allowed=5.0).select("path_id", "seq")


@query("g12_offset_lanes")
def g12(spark, d):
    return _round(paths.offset_lanes(V.paths(spark, d).select("path_id", "seq", "x", "y", "z"), 4, 2.0))


@query("g13_particles", f"WITH l AS (SELECT path_id, sum(step) AS length FROM {_STEPS} GROUP BY 1) SELECT path_id, count(*) AS n FROM l, range(8192) r(i) WHERE i < least(greatest(floor(length / 40.0::double), 1), 8192) GROUP BY 1")
def g13(spark, d):
    return paths.emit_particles(timeseries.path_lengths(V.paths(spark, d)), 40.0).groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))


@query("g15_field_from_anchors")
def g15(spark, d):
    return _round(paths.field_from_anchors(V.paths(spark, d), 50.0), 4)


@query("g16_field_from_regions")
def g16(spark, d):
    q = V.cloud_q(spark, d)
    blocked = q.where("x between 20 and 25").select("point_index", F.lit(True).alias("flow_blocked"), F.lit(False).alias("bridge_allowed"), F.lit(False).alias("bridge_blocked"))
    out = paths.field_from_regions(q, C_SHAPE, blocked, blend=_BLEND)
    return _round(out.select("point_index", "seq", "station", "wetness", "confidence", "dx", "dz"))


@query("g17_field_streamlines", f"SELECT path_id || '-' || island AS path_id, event_id FROM ({_ISLANDS})")
def g17(spark, d):
    return paths.field_streamlines(V.nodes(spark, d), resolution=0.05, max_bridge=0.3).select("path_id", "event_id")


@query("g18_field_walks")
def g18(spark, d):
    n = V.flat_q(spark, d).withColumns({"dx": F.lit(1.0), "dy": F.lit(0.0), "dz": F.lit(0.0), "confidence": F.lit(1.0)})
    seeds = n.select(F.col("point_index").alias("seed_id"), "point_index")
    return paths.field_walks(n, seeds, 0.05, 32)


@query("g19_stream_apportion", f"WITH l AS (SELECT path_id, sum(step) AS length FROM {_STEPS} GROUP BY 1) SELECT sum(1)::bigint AS paths, greatest(2000, count(*))::bigint AS streams FROM l")
def g19(spark, d):
    out = paths.apportion_streams(timeseries.path_lengths(V.paths(spark, d)), 2000)
    return out.agg(F.count(F.lit(1)).alias("paths"), F.sum("streams").alias("streams"))


@query("g19_stream_samples")
def g19_samples(spark, d):
    return _round(paths.stream_samples(timeseries.path_lengths(V.paths(spark, d)), 300, 20.0, 5.0))


@query("g23_surface_project")
def g23(spark, d):
    p = V.paths(spark, d).select("path_id", "seq", (F.col("x") / 100).alias("x"), (F.col("y") / 17).alias("y"), F.lit(0.05).alias("z"), F.lit(1.0).alias("confidence"))
    return _round(paths.project_on_surface(p, stats.surface_cells(V.flat_q(spark, d), 0.1), 0.15, 0.05).select("path_id", "seq", "z", "confidence"))


# Documents and assets

@query("d1_json_defaults", "SELECT event_id, coalesce(TRY_CAST(json_extract(props, '$.k') AS bigint), -1) AS k, 'viridis' AS colormap FROM events")
def d1(spark, d):
    e = V.table(spark, d, "events").select("event_id", "props")
    out = documents.parse_column(e, "props", "k bigint, colormap string", {"k": -1, "colormap": "viridis"})
    return out.select("event_id", "k", documents.enum_column("colormap", F.col("colormap")).alias("colormap"))


@query("src8_matrix_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::double END AS first, CASE WHEN doc_id % 3 <> 0 THEN 'a transform needs 16 numbers' END AS issue FROM documents")
def src8(spark, d):
    k = F.col("doc_id")
    text = F.concat(k.cast("string"), F.lit(" 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 "), F.when(k % 3 == 0, "1").when(k % 3 == 1, "x 1").otherwise("1 1"))
    out = assets.read_matrices(V.table(spark, d, "documents").select("doc_id", text.alias("text")))
    return out.select("doc_id", F.col("matrix")[0].alias("first"), "issue")


@query("src10_classify", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 0 THEN 'splat' ELSE 'cloud' END AS kind FROM part")
def src10(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("a/b/"), F.when(k % 4 == 0, "gSplat-").otherwise("Site "), k.cast("string"), F.when(k % 4 == 3, ".PLY").otherwise(".ply"))
    return assets.classify(V.table(spark, d, "part").select("p_partkey", path.alias("path"))).select("p_partkey", "kind")


@query("src11_summary", "SELECT 0::int AS seq, '3 clouds, 2 splats' AS line UNION ALL SELECT * FROM (VALUES (1, '[cloud] a0'), (2, '[splat] a1'), (3, '[cloud] a2'), (4, '[splat] a3'), (5, '[cloud] a4'))")
def src11(spark, d):
    r = V.table(spark, d, "region").select(F.when(F.col("r_regionkey") % 2 == 1, "splat").otherwise("cloud").alias("kind"), F.concat(F.lit("a"), F.col("r_regionkey").cast("string")).alias("path"))
    return assets.summary(r)


@query("src24_unique_names", "SELECT p_partkey AS seq, stem || CASE WHEN k = 1 THEN '' ELSE '_' || k END AS stem FROM (SELECT p_partkey, replace(p_brand, '#', '_') AS stem, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)")
def src24(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("name"))
    return assets.unique_names(p, spark.createDataFrame([], "stem string"))


@query("e91_fingerprint")
def e91(spark, d):
    return V.table(spark, d, "supplier").select("s_suppkey", documents.fingerprint_column("s_name", "s_acctbal").alias("fingerprint"))


@query("u1_layer_union", f"SELECT layer, sum(n)::bigint AS n FROM (SELECT 'q' AS layer, count(*) AS n FROM {V.Q} UNION ALL SELECT 'p', count(*) FROM {V.P}) GROUP BY 1")
def u1(spark, d):
    both = reduce(DataFrame.unionByName, [c.select("point_index", "x", "y", "z", F.lit(n).alias("layer")) for n, c in (("q", V.cloud_q(spark, d)), ("p", V.cloud_p(spark, d)))])
    return both.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
