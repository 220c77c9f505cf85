"""Shared folders for checkpoints and intermediate tables.

The cluster names its shared folder in ``spark.checkpoint.dir``; everything that
must outlive an executor is written below it. Only a local session that has no
such setting (tests) gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set(_SETTING, root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder (not created yet)."""
    return f"{shared_root(spark)}/gristmill/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
