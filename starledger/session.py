"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, partitions: int | None = None,
                app_name: str = "starledger") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE stays on so that shuffle partitions are coalesced, skewed join
    partitions are split, and joins whose measured side is small become
    broadcast joins at run time.  The UI is off: no port is opened.

    Validation and mapping stages fuse many expressions into one generated
    method; the JVM by default refuses to JIT-compile methods over 8000
    bytecode bytes and would interpret them (measured: 3x slower intake), so
    huge-method compilation is enabled for the driver and the executors.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    if partitions:  # else the cluster's own setting holds
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator of the cluster and
    is shared storage; it is only read here.  Only when it is unset and the
    master is local (tests) is a scratch folder created and registered; on a
    cluster that is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="starledger-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written
    intermediate table (never a machine-local temporary folder on a cluster)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"
