"""Tables in the shared folder, joins with hot keys, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that ``shared`` has written and nothing has removed yet.
_written: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            context.setCheckpointDir("/tmp/checkpoints")  # one machine only, as in tests
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def shared(df: DataFrame) -> DataFrame:
    """The rows, computed once and written as a Parquet table to the folder that the cluster names in spark.checkpoint.dir.

    What reads it starts from there, so a lost executor costs no more than the tasks it ran.  The table is removed by the
    ``tables`` scope it is written in, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/cloudloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(since: int) -> None:
    while len(_written) > since:
        spark, path = _written.pop()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end the tables written within it, but for the last one before the yielded function was called."""
    since, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_written.pop())
        return df

    try:
        yield keep
    finally:
        _remove(since)
        _written.extend(kept)


@atexit.register
def _remove_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _remove(0)


def hot_join(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner", *, hot: int = 1024) -> DataFrame:
    """``rows`` joined with ``few``, which has one row for each key, without one task for the rows of a frequent key.

    A key with at least 1 / hot of all rows is hot: there are ``hot`` of them at most, so their rows of ``few`` are broadcast and
    ``rows`` of these keys stay where they are.  The rest is an ordinary join.  Null keys meet nothing.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > 64)
    total = rows.count()
    found = counts.where(F.col("n_") * hot >= total).collect()
    if not found:
        return rows.join(few, on, how)
    spark, kinds = rows.sparkSession, few.select(*on).schema
    keys = [tuple(r)[:-1] for r in found if None not in tuple(r)]
    often = F.broadcast(few.join(F.broadcast(spark.createDataFrame(keys, kinds)), on, "left_semi"))
    if len(keys) == len(found) and sum(r["n_"] for r in found) == total:  # hot keys alone, as with few languages
        return rows.join(often, on, how)
    names = F.broadcast(spark.createDataFrame(keys, rows.select(*on).schema).withColumn("hot_", F.lit(True)))
    marked = rows.join(names, on, "left")
    return marked.where("hot_").drop("hot_").join(often, on, how).unionByName(marked.where(F.col("hot_").isNull()).drop("hot_").join(few, on, how))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the component is its smallest node.

    Each round, every node takes the smallest label among its neighbours, and then its label's label, so that long chains
    halve.  The edges are written once; a round shuffles one label per edge, with the least taken before the shuffle.  Labels only fall, so the rounds end.
    """
    both = shared(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = shared(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        better = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("via"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        new = shared(better.join(up, F.col("via") == F.col("up")).select("node", "old", F.least("via", "up_label").alias("label")))
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def free_name(name: str, taken: list[str]) -> str:
    """The name, or one made from it that is not taken, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"mix_{name}"
    return name
