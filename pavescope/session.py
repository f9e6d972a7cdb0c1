"""Session defaults: UTC, adaptive execution, and partition counts left to the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "pavescope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    return builder.config(map=base | conf).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in spark.checkpoint.dir; where that is unset, in a folder of the warehouse, which executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or f"{warehouse}/_checkpoints")
    return df.checkpoint()
