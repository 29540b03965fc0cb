"""Session construction and shared-folder helpers.

On a cluster the shared checkpoint folder comes from ``spark.checkpoint.dir``;
we only pick a local folder when the setting is absent (local runs, tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings the operators rely on. The two JSON settings give Python
# ``json`` semantics for duplicate keys (the last one wins).
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "evalkit",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("EVALKIT_DRIVER_MEMORY", "16g")))
    conf = dict(SESSION_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# settings a caller's session keeps as it is (no query depends on them)
CALLER_OWNED = {"spark.sql.session.timeZone"}


def apply_session_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings above on an existing session (the caller's
    time zone is left alone: timestamps here are wall-clock TIMESTAMP_NTZ)."""
    for k, v in SESSION_CONF.items():
        if k not in CALLER_OWNED and spark.conf.isModifiable(k) and spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. Only a local-mode session without the
    setting (tests, a laptop) gets a fresh local folder."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's setting is used as is
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise RuntimeError("spark.checkpoint.dir is not set on the server session")
        return current.rstrip("/")
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: point it to a folder all executors share "
                           "(a machine-local folder would not survive the loss of that machine)")
    local = tempfile.mkdtemp(prefix="evalkit-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return sc.getCheckpointDir().rstrip("/")


#: Folders of written tables that this process has asked for.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables. Results may be
    read from it lazily, so it stays until ``remove_scratch``."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/evalkit-scratch/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The file system and path object of a folder, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove_scratch(spark: SparkSession) -> int:
    """Delete the tables this process has written to scratch folders; returns how many there
    were. To be called when the results that read them are no longer needed."""
    paths, n = list(_SCRATCH), 0
    for path in paths:
        fs, place = hadoop_path(spark, path)
        n += bool(fs.delete(place, True))
        _SCRATCH.remove(path)
    return n
