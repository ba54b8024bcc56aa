"""Discovery of assets, transform matrices, catalogues and output names (SRC8-SRC11, SRC23-SRC25, J1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.functions import scalar as S
from cloudloom.operators import spatial


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC9: path and size of all files below a folder, in order; contents are not read.  A missing root gives no rows."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except Exception as e:  # noqa: BLE001  the reader names a missing path only in its message
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length long")
    return files.select("path", "length").orderBy("path")


def split_paths(files: DataFrame) -> DataFrame:
    """dir, name, stem and ext of each path."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.withColumns({"dir": F.regexp_replace("path", "/[^/]*$", ""), "name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "ext": F.regexp_extract(name, r"\.[^.]*$", 0)})


def classify(files: DataFrame, looks: Callable[[str], str] | None = None) -> DataFrame:
    """SRC10: kind of each .ply file: splat if its name says so or ``looks`` (path -> kind, by header) does; else cloud; others are issues."""
    parts = split_paths(files)
    kind = F.when(F.col("ext") != ".ply", F.lit(None).cast("string")).when(F.col("name").startswith("gSplat-"), "splat")
    if looks is None:
        kind = kind.otherwise("cloud")
    else:
        kind = kind.otherwise(F.pandas_udf(lambda paths: paths.map(looks), "string", F.PandasUDFType.SCALAR)("path"))  # a header read a file: no column function opens files
    out = parts.withColumn("kind", kind)
    return out.withColumn("issue", F.when(F.col("kind").isNull() & (F.col("ext") != ".txt"), F.lit("not a point cloud")))


def look_at_header(path: str) -> str | None:
    """The kind that a file's header shows; none for what can't be read."""
    from cloudloom.sources import ply

    try:
        h = ply.read_header(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    except (OSError, ValueError):
        return None
    return "splat" if h.is_splat else "cloud" if h.is_cloud else None


def read_matrices(texts: DataFrame) -> DataFrame:
    """SRC8: 16 numbers of each text (path, text), row-major.  Reading a line stops at what is no number; any other count is an issue.

    Added: matrix (null unless 16) and issue.
    """
    words = F.filter(F.flatten(F.transform(F.split("text", "\n"), _numbers)), lambda w: w.isNotNull())
    out = texts.withColumn("numbers", words)
    ok = F.size("numbers") == 16
    return out.withColumns({"matrix": F.when(ok, F.col("numbers")), "issue": F.when(~ok, F.lit("a transform needs 16 numbers"))}).drop("numbers")


def _numbers(line):
    """The leading numbers of a line."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    values = F.transform(words, lambda w: w.try_cast("double"))
    end = F.array_position(F.transform(values, lambda v: v.isNull()), True)
    return F.when(end > 0, F.slice(values, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(values)


def catalogue(assets: DataFrame, matrices: DataFrame) -> DataFrame:
    """Clouds and splats with the splats' transforms, and issues."""
    clouds = assets.where(F.col("kind") == "cloud").select("kind", "path", F.lit(None).cast("array<double>").alias("matrix"), F.lit(None).cast("string").alias("issue"))
    splats = spatial.transform_pairing(assets.where(F.col("kind") == "splat").select("kind", "path", "dir", "stem"), matrices)
    return clouds.unionByName(splats.select("kind", "path", "matrix", "issue"))


def summary(assets: DataFrame) -> DataFrame:
    """SRC11: a line of counts, then a line for each asset."""
    counts = assets.agg(F.concat_ws(", ", *[F.concat(F.sum((F.col("kind") == k).cast("long")).cast("string"), F.lit(f" {k}s")) for k in ("cloud", "splat")]).alias("line")).select(F.lit(0).alias("seq"), "line")
    lines = assets.select((F.row_number().over(Window.orderBy("path"))).alias("seq"), F.concat_ws(" ", F.concat(F.lit("["), F.col("kind"), F.lit("]")), "path").alias("line"))
    return counts.unionByName(lines)


def unique_names(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """SRC24: output stems of rows (seq, name): sanitised; the k-th of a stem gets _k, past those in ``taken`` (stem)."""
    clean = rows.withColumn("stem", S.stem(F.col("name")))
    used = taken.groupBy(F.regexp_replace("stem", r"_\d+$", "").alias("stem")).agg(F.max(F.coalesce(F.nullif(F.regexp_extract("stem", r"_(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))).alias("last"))
    k = F.row_number().over(Window.partitionBy("stem").orderBy("seq"))
    both = clean.withColumn("k", k).join(used, "stem", "left").withColumn("n", F.col("k") + F.coalesce("last", F.lit(0)))
    return both.select("seq", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("n").cast("string"))).alias("stem"))


def encoder_command(width: int, height: int, fps: int, out: str) -> list[str]:
    """SRC23: arguments that encode raw RGBA frames from standard input."""
    return ["ffmpeg", "-y", "-f", "rawvideo", "-pix_fmt", "rgba", "-s", f"{width}x{height}", "-r", str(fps), "-i", "-", "-c:v", "libx264", "-crf", "18", "-pix_fmt", "yuv420p", out]
