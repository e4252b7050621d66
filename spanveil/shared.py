"""The folder that the driver and all executors share, and frames cut off from their past."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names in the session, or that is set on its context; an own one only where none is and all runs on this machine."""
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spanveil-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder: evaluated once, and whole when executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
