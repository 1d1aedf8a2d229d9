"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers that start from now on find this package wherever the driver's process was started."""
    workers = spark.sparkContext.environment
    known = workers.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        workers["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def local_session(cores: int = 8, memory: str = "16g", name: str = "taufold", shared: str | None = None) -> SparkSession:
    """``shared`` is the folder of stage tables; without one, a local run takes a temporary folder when it needs it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()
