"""Tables that cut a plan: written once to the folder that executors share and read back, so they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below spark.checkpoint.dir; where it is unset, below a temporary one, if all executors are this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="veridoc-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table of its own: what stands above it is planned once, however often it is used."""
    path = own_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
