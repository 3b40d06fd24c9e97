"""Where streams keep checkpoints, state tables and results.

On a cluster every executor has to reach these files, so the folder is the one
the cluster names in ``spark.checkpoint.dir``. Only a local session, which is
one machine by definition, falls back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}
_standing: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="gridsight-")
    return _local_roots[context.applicationId]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared root."""
    folder = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _standing.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def folders(spark: SparkSession) -> list[str]:
    """The folders this application was given and has not removed, in order."""
    return list(_standing.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, names: list[str]) -> None:
    """Removes folders whose tables are read no more; results that were not written yet may still read theirs."""
    standing = _standing.get(spark.sparkContext.applicationId, [])
    for name in names:
        if name in standing:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            standing.remove(name)
