"""SparkSession factory and session-level helpers.

Settings are chosen for correctness first (UTC, ANSI left on) and then for
scale: AQE re-plans every exchange at run time (coalescing small shuffle
partitions, splitting skewed ones, demoting sort-merge joins to broadcast when
the measured side is small), so the code never hard-codes a join strategy for
inputs whose size grows with the data.
"""

from __future__ import annotations

import os
import shlex
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what the planner can prove small (file/column statistics)
    # or what AQE measured small at run time; both are size-checked.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    app_name: str = "tallyspark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) the active session with the library defaults.

    ``master`` defaults to ``local[*]`` only when the configuration names none,
    so the same call works under ``spark-submit`` on a cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    if master or not _configured_master():
        builder = builder.master(master or "local[*]")
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _configured_master() -> str | None:
    """The master of the running session, or the one that the launcher names.

    No JVM is started to find out: it would start without the settings of this session.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active.sparkContext.master
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # under spark-submit the JVM is there
        SparkContext._ensure_initialized()
        return SparkConf().get("spark.master", None)
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for i, arg in enumerate(args):
        if arg == "--master":
            return args[i + 1]
        if arg.startswith(("--master=", "spark.master=")):
            return arg.split("=", 1)[1]
    return os.environ.get("SPARK_MASTER") or os.environ.get("MASTER")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is used as-is. Only a
    local master may leave it unset (tests); it then gets a private folder. On
    a cluster such a folder would not be shared, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)
