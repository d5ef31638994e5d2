"""Tables written once to the folder that driver and executors share, and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where nothing is set and the master is local, a folder of this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(root, exist_ok=True)
    sc.setCheckpointDir(tempfile.mkdtemp(dir=root))
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """df, computed once and read back, so that its lineage is cut."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
