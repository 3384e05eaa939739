"""Session construction and shared-folder handling.

On a cluster the session is created by the platform; ``get_spark`` only fills in settings
that are unset, so an operator never overrides the cluster's own configuration.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings applied only when the running session has no value of its own.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "hazardframe") -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("HF_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and checkpoints.

    In this order: ``spark.checkpoint.dir`` of the session, the folder that the program has set with
    ``setCheckpointDir``, and only with a local master (tests) a fresh scratch folder. A cluster
    without either is an error: a machine-local folder would be lost to the other executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:  # a classic session; a remote (Connect) session has no SparkContext
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        pass
    if sc is not None:
        d = d or sc.getConf().get("spark.checkpoint.dir", None)
        program = sc.getCheckpointDir()
        if program and (not d or _ours.get(sc.applicationId) == program):
            return d or program
        if not d:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="hf-ckpt-", dir=os.environ.get("HF_SCRATCH", "/tmp"))
        if not program:
            sc.setCheckpointDir(d)
            _ours[sc.applicationId] = sc.getCheckpointDir()
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return d


#: Per application, the checkpoint folder that ``checkpoint_dir`` has set itself.
_ours: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_parallelism(df, min_partitions: int | None = None):
    """Spread a frame over the cluster when its source plans fewer splits than there are cores.

    A source stored as one file with one row group is read by a single task, and every
    row-wise expression after it (regex rules, edit distances) would run on one core. Such a
    frame is round-robin repartitioned to the default parallelism; a frame that already has
    enough partitions (any large input) is returned unchanged, so no shuffle is added at scale.
    Checking the partition count plans the scan but runs no job.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - remote sessions expose no RDDs; keep the source as is
        return df
    return df.repartition(target) if n < target else df


def shuffle_partitions(spark) -> int:
    """The session's shuffle partition count as a number (falls back to the parallelism)."""
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        try:
            return spark.sparkContext.defaultParallelism
        except Exception:  # noqa: BLE001
            return 200


def dealt_partitions(spark) -> int:
    """Partitions for small rows that take long to work on: a given number, which AQE does not merge by their bytes."""
    n = shuffle_partitions(spark)
    try:
        return max(n, 4 * spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - remote sessions don't tell
        return n


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``hazardframe`` importable in Python workers (Arrow UDF, mapInPandas).

    The package is zipped once and added with ``addPyFile``, the standard way to send Python
    code to executors; workers put it on their path for every task. Done once per context.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions ship code differently (spark.addArtifacts)
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    from pathlib import Path

    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="hf-pkg-")) / "hazardframe_pkg"
    archive = shutil.make_archive(str(out), "zip", root_dir=str(pkg.parent), base_dir=pkg.name)
    sc.addPyFile(archive)
    _SHIPPED.add(key)
