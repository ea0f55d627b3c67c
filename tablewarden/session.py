"""Session settings that a run relies on."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

PINS = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true"}


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster, sessions come from elsewhere and are only pinned."""
    conf = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g"} | PINS
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one serves a session on one machine only."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tablewarden-")


@contextmanager
def pinned(spark: SparkSession):
    """UTC, and column names by exact case, while contracts are evaluated."""
    old = {k: spark.conf.get(k, None) for k in PINS}
    for k, v in PINS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
