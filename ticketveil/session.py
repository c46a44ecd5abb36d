"""Session for tests and single-machine runs; on a cluster use the session you are given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    name: str, cpus: int | str = "*", memory: str = "16g", checkpoint_dir: str | None = None
) -> SparkSession:
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()
