"""Tables that cut lineage: written once to the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """The rows, computed once: a Parquet table in the folder that spark.checkpoint.dir names.

    All that reads it sees the same rows in the same partitions' order, whatever columns it takes.  On a single machine, where the setting may be unset, a local folder is used.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            context.setCheckpointDir("/tmp/checkpoints")
        folder = context._jsc.sc().getCheckpointDir().get()
    path = f"{folder.rstrip('/')}/cloudloom-core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
