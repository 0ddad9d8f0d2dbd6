"""Settings of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a folder for checkpoints: its own setting, or for a local master a folder of this machine."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lawloom-')}")
    return spark


def shared_path(spark: SparkSession, name: str, *, base: str | None = None) -> str:
    """A new path below ``base``, by default the folder that the driver and all executors share."""
    base = base or spark.conf.get("spark.checkpoint.dir", None) or with_checkpoints(spark).sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch handed to Python; 10,000 rows of long texts or packed vectors are otherwise one batch."""
    set_to = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) or "-1"
    if not set_to.isdigit() or not 0 < int(set_to) <= size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
