"""Stage tables: Parquet tables that link two jobs and cut lineage.

A stage table lives in the shared folder the cluster names in
``spark.checkpoint.dir``.  Written tables survive the loss of any executor and
are read back with column pruning, which an RDD checkpoint is not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="stage-")
    return _local_dirs[sc.applicationId]


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
