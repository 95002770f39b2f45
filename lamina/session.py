"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

# Timestamps are wall-clock values; UTC keeps casts to and from them exact.
# Skew handling splits a hot join key over many tasks at run time, also where an
# aggregation above the join would else have spared itself a shuffle.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Settings a session must be started with. Composing a plan crosses to the JVM
# for every expression; without the call-site capture, which only error
# messages use, it does so far less.
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that already exists."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def start(master: str, name: str = "lamina", **settings: str) -> SparkSession:
    """A session with all of the above; keyword names use `_` for `.`."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**RUNTIME, **STATIC, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Folder for written tables that all executors see: `spark.checkpoint.dir`, else one in the warehouse.

    A warehouse on the driver's own disk is no such folder on a cluster, and is refused there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    home = spark.conf.get("spark.sql.warehouse.dir")
    if urlparse(home).scheme in ("", "file") and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{home.rstrip('/')}/_work"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
