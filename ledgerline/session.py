"""Session construction and the shared work folder.

Library code never creates machine-local folders on a cluster: tables that cut
lineage, staging tables and streaming checkpoints live under the folder the
cluster names in ``spark.checkpoint.dir``.  Only a local-mode session (tests,
bench) without that setting gets a fresh temporary folder of its own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "ledgerline",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with AQE on, the UI off and a UTC session zone."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for lineage-cutting tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or a checkpoint dir already set on the
    context).  When neither is set, a local-mode session gets a fresh temporary
    folder; any other master is an error, since a machine-local folder is not
    visible to executors on other hosts.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no local SparkContext
        sc = None
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if conf_dir:
        return conf_dir.rstrip("/")
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder shared by all "
            "executors (e.g. on the cluster's distributed file system)"
        )
    local_dir = tempfile.mkdtemp(prefix="ledgerline-work-")
    if sc is None:
        return local_dir
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir().rstrip("/")
