"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "velonet", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, Arrow. Partition counts are left to the cluster's configuration.

    Call sites of columns are not recorded: the rules are thousands of columns, and recording takes a quarter of their making.
    """
    build = SparkSession.builder.appName(name)
    if master:
        build = build.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | conf
    for k, v in settings.items():
        build = build.config(k, v)
    return build.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all machines share: the one that is set, or that spark.checkpoint.dir names.

    Only a local master, where driver and executors are one process, may do without; it gets a temporary folder. Elsewhere
    a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="velonet-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
