"""A folder for tables that queries derive from others."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; a cluster
    without it is an error, as executors do not share local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="proxyscope-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/proxyscope-{spark.sparkContext.applicationId}"
