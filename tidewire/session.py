"""Checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, a temporary one if driver and executors are one process on one machine
    (master ``local``), as in tests; on a cluster that is an error, as executors could not read what others wrote."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which a lost executor doesn't take away."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
