from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split; other settings are the cluster's."""
    b = SparkSession.builder.appName("cardlake")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the driver and all executors can write: in spark.checkpoint.dir, or a local one if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='cardlake-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
