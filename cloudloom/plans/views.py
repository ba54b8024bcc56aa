"""The star-schema tables seen as clouds, splats, paths and pixels, in Spark and in SQL.

P: orders, a point for each; Q: parts; L: line items; splats: embeddings; paths: a user's events in order; nodes: the same with flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_index"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"), day.alias("z"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


P = "(SELECT o_orderkey AS point_index, o_custkey::double AS x, o_totalprice / 1000 AS y, date_diff('day', DATE '1970-01-01', o_orderdate::date)::double AS z, o_totalprice AS price, o_orderstatus AS status FROM orders)"


def cloud_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("point_index"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 97).cast("double").alias("z"), F.col("p_retailprice").alias("v"), F.col("p_brand").alias("brand"))


Q = "(SELECT p_partkey AS point_index, p_size::double AS x, p_retailprice AS y, (p_partkey % 97)::double AS z, p_retailprice AS v, p_brand AS brand FROM part)"


def flat_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q scaled to about a unit square with a little height, for neighbour searches."""
    q = cloud_q(spark, sf_dir)
    return q.select("point_index", (F.col("x") / 50).alias("x"), ((F.col("y") - 900) / 100).alias("y"), (F.col("z") / 970).alias("z"), "v")


FLAT_Q = f"(SELECT point_index, x / 50 AS x, (y - 900) / 100 AS y, z / 970 AS z, v FROM {Q})"


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    at = lambda i: e[i].cast("double")
    part = lambda a, n: F.transform(F.slice(e, a + 1, n), lambda v: v.cast("double"))
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("point_index"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), part(3, 48).alias("sh"), at(51).alias("opacity"), part(52, 3).alias("scale"), part(55, 4).alias("rot"), F.col("label").cast("long").alias("layer"))


SPLATS = "(SELECT vec_id AS point_index, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, list_transform(embedding[4:51], lambda v: v::double) AS sh, embedding[52]::double AS opacity, list_transform(embedding[53:55], lambda v: v::double) AS scale, list_transform(embedding[56:59], lambda v: v::double) AS rot, label::bigint AS layer FROM embeddings)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("path_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), "event_id", "event_type", F.col("value").alias("x"), (F.col("event_id") % 17).cast("double").alias("y"), (F.col("event_id") % 5).cast("double").alias("z"))


PATHS = "(SELECT user_id AS path_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::bigint AS seq, event_id, event_type, value AS x, (event_id % 17)::double AS y, (event_id % 5)::double AS z FROM events)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    k = F.col("event_id")
    return p.select("path_id", "seq", "event_id", (F.col("x") / 100).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), ((k * 7 % 100) / 100).alias("confidence"), (k % 29 == 0).alias("flow_blocked"), (k % 11 == 0).alias("bridge_allowed"), (k % 37 == 0).alias("bridge_blocked"))


NODES = f"(SELECT path_id, seq, event_id, x / 100 AS x, 0.0::double AS y, 0.0::double AS z, (event_id * 7 % 100) / 100 AS confidence, event_id % 29 = 0 AS flow_blocked, event_id % 11 = 0 AS bridge_allowed, event_id % 37 = 0 AS bridge_blocked FROM {PATHS})"


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fragments on a 64 x 64 picture."""
    o = cloud_p(spark, sf_dir)
    k = F.col("point_index")
    return o.select("point_index", (k % 64).cast("int").alias("ix"), (F.floor(k / 64) % 64).cast("int").alias("iy"), (1 + F.col("y") / 100).alias("depth"), (k % 3).cast("long").alias("layer"), ((k * 13 % 256) / 255).alias("r"), ((k * 29 % 256) / 255).alias("g"), ((k * 53 % 256) / 255).alias("b"), (0.1 + (k % 8) / 10).alias("alpha"))


FRAGMENTS = f"(SELECT point_index, (point_index % 64)::int AS ix, (point_index // 64 % 64)::int AS iy, 1 + y / 100 AS depth, point_index % 3 AS layer, (point_index * 13 % 256) / 255 AS r, (point_index * 29 % 256) / 255 AS g, (point_index * 53 % 256) / 255 AS b, 0.1::double + (point_index % 8) / 10 AS alpha FROM {P})"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture 64 pixels wide, as high as there are parts for, one a pixel; each seventh pixel is a hole, of alpha 0."""
    q = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return q.select((k % 64).cast("int").alias("ix"), F.floor(k / 64).cast("int").alias("iy"), ((k * 13 % 256) / 255).alias("r"), ((k * 29 % 256) / 255).alias("g"), ((k * 53 % 256) / 255).alias("b"), F.when(k % 7 == 3, 0.0).otherwise((1 + k % 4) / 4).alias("alpha"), (2 + (k * 17 % 50) / 10).alias("depth"))


PIXELS = "(SELECT (p_partkey % 64)::int AS ix, (p_partkey // 64)::int AS iy, (p_partkey * 13 % 256) / 255 AS r, (p_partkey * 29 % 256) / 255 AS g, (p_partkey * 53 % 256) / 255 AS b, CASE WHEN p_partkey % 7 = 3 THEN 0 ELSE (1 + p_partkey % 4) / 4 END AS alpha, 2 + (p_partkey * 17 % 50) / 10 AS depth FROM part)"
