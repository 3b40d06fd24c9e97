"""Closed sets of names, with the name used for anything unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted names and the default of each set.
ENUMS: dict[str, tuple[list[str], str]] = {
    "run_status": (
        [
            "starting", "running", "skipped", "stopped", "not running", "completed", "started", "not started",
            "failed", "succeeded", "waiting", "exceeded", "unknown", "push logs",
        ],
        "unknown",
    ),
    "job_type": (["spark", "flink", "pipeline", "default"], "default"),
    "cluster_provider": (
        [
            "local", "sandbox", "production", "sandbox-docker", "sandbox-kubernetes", "spark-standalone", "k8s",
            "yarn", "emr", "dataproc", "databricks",
        ],
        "local",
    ),
    "cluster_status": (
        [
            "unknown", "starting", "new", "downloading", "bootstrapping", "running", "waiting", "terminating",
            "terminated", "inactive", "deleted", "stopping", "terminated_with_errors", "failed_while_downloading",
        ],
        "unknown",
    ),
    "severity": (["info", "warn", "error", "fatal"], "info"),
    "error_source": (["code", "runtime", "configuration"], "code"),
    "trigger": (["manually", "by agent"], "manually"),
}


def normalise(value: Column, kind: str) -> Column:
    """The value if the set knows it, else the default of the set."""
    known, default = ENUMS[kind]
    return F.when(value.isin(known), value).otherwise(F.lit(default))


def provider_of(resource_manager: Column) -> Column:
    """Cluster provider of a resource manager address; null when unknown."""
    return (
        F.when(F.startswith(resource_manager, F.lit("spark://")), F.lit("spark-standalone"))
        .when(F.lower(resource_manager) == "yarn", F.lit("yarn"))
        .when(F.startswith(resource_manager, F.lit("k8s://")), F.lit("k8s"))
    )
