"""Session builder for local work and the shared scratch folder of a running session."""

from __future__ import annotations

import re
import tempfile

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "matchspark") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go when the statement that made them ends, not when the driver happens to collect its garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession, *parts: str) -> str:
    """Folder that every executor can reach, below ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) that names no such folder gets one of its own; on a cluster each
    machine would write to its own disk, so there the setting is needed.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = _LOCAL_SCRATCH.get(app)
        if base is None:
            base = _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="matchspark-")
            spark.sparkContext.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), f"matchspark-{app}", *parts])
