"""Caches of paths and fields, and render jobs, as documents and tables (SRC18, SRC19, D8j, D14j, D15j)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.sources import documents

FIELD_CACHE_VERSION = 1
# Keys of cached branches and anchors with what is assumed where they are missing.
BRANCH: dict[str, Any] = {"branch_id": 0, "emitter_id": 0, "parent_id": -1, "branch_role": "main", "termination": "empty", "anchors": []}
ANCHOR: dict[str, Any] = {"position": [0.0, 0.0, 0.0], "normal": [0.0, 0.0, 1.0], "path_distance": 0.0, "confidence": 1.0, "wetness": 0.0, "gap_count": 0, "source_point_index": -1}
JOB: dict[str, Any] = {"name": "Render", "width": 1920, "height": 1080, "tile": 512, "fps": 30, "first_frame": 0, "last_frame": 0, "output_folder": "", "format": "exr"}
_ANCHOR_DDL = "position array<double>, normal array<double>, path_distance double, confidence double, wetness double, gap_count long, source_point_index long"
PATH_CACHE_DDL = f"branches array<struct<branch_id: long, emitter_id: long, parent_id: long, branch_role: string, termination: string, anchors: array<struct<{', '.join(f'{k}: {t}' for k, t in (x.strip().split(' ', 1) for x in _ANCHOR_DDL.split(', ')))}>>>>"


def branch(value: Mapping | None) -> dict:
    """D14j: a cached branch with its anchors, what is missing filled in."""
    out = documents.with_defaults(value, BRANCH)
    out["anchors"] = [documents.with_defaults(a, ANCHOR) for a in out["anchors"]]
    return out


def path_cache(value: Mapping | None) -> dict:
    """SRC18: the document of traced branches."""
    doc = dict(value or {})
    return {"version": int(doc.get("version", 1)), "branches": [branch(b) for b in doc.get("branches", [])]}


def path_cache_tables(caches: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """SRC18 over a table: (branches, anchors) of the JSON documents in ``column``; the other columns go along.

    Missing keys get their defaults, unknown roles and terminations their first member; documents that are no JSON have no branches.
    """
    keys = [c for c in caches.columns if c != column]
    each = caches.select(*keys, F.posexplode(F.from_json(column, PATH_CACHE_DDL)["branches"]).alias("seq", "b"))
    pick = lambda c: documents.enum_column(c, F.col(f"b.{c}")) if c in documents.ENUMS else F.coalesce(F.col(f"b.{c}"), F.lit(BRANCH[c]).cast("long"))
    branches = each.select(*keys, *[pick(c).alias(c) for c in BRANCH if c != "anchors"])
    at = each.select(*keys, pick("branch_id").alias("branch_id"), F.posexplode("b.anchors").alias("seq", "a"))
    vector = lambda c, i: F.coalesce(F.get(F.col(f"a.{c}"), F.lit(i)), F.lit(ANCHOR[c][i]))
    places = [vector("position", i).alias(n) for i, n in enumerate("xyz")] + [vector("normal", i).alias(f"n{n}") for i, n in enumerate("xyz")]
    rest = [F.coalesce(F.col(f"a.{c}"), F.lit(d).cast("double" if isinstance(d, float) else "long")).alias(c) for c, d in ANCHOR.items() if not isinstance(d, list)]
    return branches, at.select(*keys, "branch_id", "seq", *places, *rest)


def path_cache_column(branches: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """SRC18: (key, document): the tables written back as one JSON document for each key; a document holds the branches of one source."""
    a = F.struct(F.array("x", "y", "z").alias("position"), F.array("nx", "ny", "nz").alias("normal"), *[F.col(c) for c, d in ANCHOR.items() if not isinstance(d, list)])
    of_branch = anchors.groupBy(key, "branch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", a.alias("a")))), lambda x: x["a"]).alias("anchors"))
    b = F.struct(*[F.col(c) for c in BRANCH])
    both = branches.join(of_branch, [key, "branch_id"], "left").withColumn("anchors", F.coalesce("anchors", F.array().cast(of_branch.schema["anchors"].dataType)))
    return both.groupBy(key).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array_sort(F.collect_list(b)).alias("branches"))).alias("document"))


def save_field_cache(nodes: DataFrame, settings: Mapping, path: str) -> None:
    """SRC19: field nodes as Parquet, with the version and settings they were baked with in a table beside them."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(FIELD_CACHE_VERSION, json.dumps(settings, sort_keys=True))], "version int, settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_field_cache(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict | None, str | None]:
    """SRC19: (nodes, settings, issue): a cache of another version, or one that is not whole, is an issue and has no nodes."""
    try:
        about = spark.read.parquet(f"{path}/about").first()
        nodes = spark.read.parquet(f"{path}/nodes")
    except Exception as e:  # what Spark raises for a missing or foreign folder depends on the file system
        return None, None, str(e).split("\n")[0]
    if about is None or about["version"] != FIELD_CACHE_VERSION:
        return None, None, f"version {about['version'] if about else None}, not {FIELD_CACHE_VERSION}"
    return nodes, json.loads(about["settings"]), None


def render_job(value: Mapping | None) -> dict:
    """D8j: sizes of one pixel or more, tiles of 16 to the picture's greater side, frames in order."""
    out = documents.with_defaults(value, JOB)
    out["width"], out["height"] = max(1, int(out["width"])), max(1, int(out["height"]))
    out["tile"] = min(max(16, int(out["tile"])), max(16, out["width"], out["height"]))
    out["fps"] = max(1, int(out["fps"]))
    out["last_frame"] = max(int(out["first_frame"]), int(out["last_frame"]))
    return out


def render_job_columns(jobs: DataFrame) -> DataFrame:
    """D8j over rows with columns of JOB's sizes and frames."""
    c = {k: F.coalesce(F.col(k), F.lit(JOB[k])) for k in ("width", "height", "tile", "fps", "first_frame", "last_frame")}
    width, height = F.greatest(c["width"], F.lit(1)), F.greatest(c["height"], F.lit(1))
    tile = F.least(F.greatest(c["tile"], F.lit(16)), F.greatest(F.lit(16), width, height))
    frames = F.greatest(c["first_frame"], c["last_frame"])
    return jobs.withColumns({"width": width, "height": height, "tile": tile, "fps": F.greatest(c["fps"], F.lit(1)), "first_frame": c["first_frame"], "last_frame": frames})


def path_array(values: Sequence[Any] | None) -> list[str]:
    """D15j: a list of paths as strings with forward slashes; what is no string goes."""
    return [v.replace("\\", "/") for v in values or [] if isinstance(v, str) and v]


def path_array_column(values: Column) -> Column:
    """D15j over an array column."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return F.transform(kept, lambda v: F.replace(v, F.lit("\\"), F.lit("/")))


def shell_quoted(text: Column) -> Column:
    """ST2: one word of a shell command."""
    plain = text.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))
