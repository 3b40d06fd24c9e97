"""The fleet registry: clusters, hosts, processes, quotas and sandboxes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import normalise
from ..functions.times import epoch_s, format_interval, time_elapsed
from .counting import with_copies
from .joins import join_reduced
from .joins import join_reduced

DELETED = "deleted"
# Fixed value: a running cluster is idle after this many seconds without a sign of life.
IDLE_TIMEOUT_S = 120
# Providers counted against each quota.
LOCAL_PROVIDERS = ["sandbox", "sandbox-docker"]
REMOTE_PROVIDERS = ["spark-standalone", "k8s", "yarn"]
# The state a command leads to, from each state that reacts to it.
START_TRANSITIONS = {
    "new": "downloading",
    "terminated_with_errors": "downloading",
    "terminated": "starting",
    "inactive": "starting",
}
# Where a service of its own reacts in another way.
SERVICE_TRANSITIONS = {
    ("hadoop", "terminated_with_errors"): "starting",
    ("hadoop", "failed_while_downloading"): "downloading",
}
# Ports of the services of a sandbox option.
SANDBOX_PORTS = {
    ("Spark Standalone", None): [(18080, "Spark History Server"), (8080, "Master Web UI")],
    ("Spark on YARN", "hadoop"): [
        (8088, "Resource Manager"), (50070, "HDFS Web UI"), (50075, "Data Node"), (9000, "HDFS Service"),
    ],
    ("Spark on YARN", "spark"): [(18080, "Spark History Server")],
}
# Fixed value: ports that no browser can open.
PORTS_WITHOUT_PAGE = [9000]


def _live() -> Column:
    return F.col("status") != DELETED


def _view(clusters: DataFrame, now: Column) -> DataFrame:
    return clusters.select(
        F.col("id").alias("cluster_id"),
        "workspace_id",
        "name",
        "service_name",
        "service_version",
        "provider_cluster_id",
        "provider",
        normalise(F.col("status"), "cluster_status").alias("status"),
        F.concat(time_elapsed("dt_added", now), F.lit(" ago")).alias("created"),
    )


def active_clusters(clusters: DataFrame, now: Column) -> DataFrame:
    """Clusters that are not deleted, with their age."""
    return _view(clusters.filter(_live()), now)


def clusters_by_status(clusters: DataFrame, status: str, now: Column) -> DataFrame:
    """R2: clusters in one state, with their age."""
    return _view(clusters.filter(F.col("status") == status), now)


def cluster_ids_by_service(clusters: DataFrame, block_size: int = 1000) -> DataFrame:
    """Ids of the live clusters of each service, in blocks of neighbouring ids.

    Ids are unique, so a block holds at most ``block_size`` of them however
    many clusters a service has.
    """
    block = F.call_function("div", F.col("id"), F.lit(block_size))
    return (
        clusters.filter(_live())
        .groupBy("service_name", block.alias("block"))
        .agg(F.sort_array(F.collect_list("id")).alias("cluster_ids"))
    )


def union_services(service_tables: Mapping[str, DataFrame]) -> DataFrame:
    """The per-service tables under one schema, columns a service lacks being null."""
    parts = [table.withColumn("service_name", F.lit(service)) for service, table in service_tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def cluster_packages(
    clusters: DataFrame, service_tables: Mapping[str, DataFrame], processes: DataFrame
) -> DataFrame:
    """Processes of the live clusters, a row each, with version and user configuration of the cluster."""
    known = clusters.filter(_live()).select(
        F.col("id").alias("cluster_id"), "workspace_id", F.col("name").alias("cluster_name"), "status", "service_name"
    )
    config = F.coalesce(F.split("configuration_params", "\n"), F.array().cast("array<string>"))
    described = known.join(union_services(service_tables), ["cluster_id", "service_name"]).select(
        "cluster_id", "workspace_id", "cluster_name", "status", "service_name", "version", "scala_version",
        config.alias("user_config"),
    )
    counted = with_copies(processes, ["cluster_id", "name", "host_ip", "port"]).withColumnRenamed("name", "process_name")
    return join_reduced(counted, described, ["cluster_id"])


def cluster_info(
    clusters: DataFrame, service_tables: Mapping[str, DataFrame], processes: DataFrame, names: Sequence[str]
) -> DataFrame:
    """Cluster details and the number of processes of each given name, ignoring case."""
    column = {name: name.lower().replace(" ", "_") + "_count" for name in names}
    counts = processes.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("process_count"),
        *[F.count_if(F.lower("name") == name.lower()).alias(column[name]) for name in names],
    )
    zero = F.lit(0).cast("bigint")
    return (
        clusters.select(
            F.col("id").alias("cluster_id"), "workspace_id", F.col("name").alias("cluster_name"), "status",
            "status_detail", "service_name",
        )
        .join(union_services(service_tables), ["cluster_id", "service_name"])
        .join(counts, "cluster_id", "left")
        .select(
            "cluster_id", "workspace_id", "cluster_name", "service_name", "version", "scala_version", "status",
            "status_detail",
            *[F.coalesce(name, zero).alias(name) for name in ["process_count", *column.values()]],
        )
    )


def find_process(processes: DataFrame, clusters: DataFrame, pattern: str) -> DataFrame:
    """Processes whose name matches the pattern, ignoring case."""
    found = processes.filter(F.col("name").ilike(pattern))
    owners = clusters.select(F.col("id").alias("cluster_id"), "workspace_id")
    return found.join(owners, "cluster_id").select(
        "cluster_id", "workspace_id", "name", "host_ip", "port", normalise(F.col("status"), "run_status").alias("status")
    )


def host_inventory(hosts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Hosts of each workspace with the services of their live clusters, a row per host and service.

    A host has its address, its state, the time it was added in epoch seconds,
    and the provider of the cluster.
    """
    served = clusters.filter(_live()).select(
        F.col("id").alias("cluster_id"), "workspace_id", "provider", "service_name", "service_version"
    )
    own = hosts.select(
        F.col("name").alias("host"), "cluster_id", "host_ip", normalise(F.col("status"), "cluster_status").alias("status"),
        F.unix_seconds(F.col("dt_added").cast("timestamp")).alias("added"),
    )
    columns = ["workspace_id", "host", "host_ip", "status", "added", "provider", "cluster_id", "service_name", "service_version"]
    return with_copies(own.join(served, "cluster_id"), columns)


def quota_check(clusters: DataFrame, workspaces: DataFrame, plans: DataFrame) -> DataFrame:
    """Local and remote clusters of each organisation against its plan.

    Local counts leave out deleted clusters; remote counts go by provider. An
    organisation without a plan may add none.
    """
    used = clusters.groupBy("workspace_id").agg(
        F.count_if(F.col("provider").isin(LOCAL_PROVIDERS) & _live()).alias("local_clusters"),
        F.count_if(F.col("provider").isin(REMOTE_PROVIDERS)).alias("remote_clusters"),
    )
    zero = F.lit(0).cast("bigint")
    per_org = (
        workspaces.select(F.col("id").alias("workspace_id"), "org_id")
        .join(used, "workspace_id", "left")
        .groupBy("org_id")
        .agg(
            F.coalesce(F.sum("local_clusters"), zero).alias("local_clusters"),
            F.coalesce(F.sum("remote_clusters"), zero).alias("remote_clusters"),
        )
    )
    return per_org.join(plans, "org_id", "left").select(
        "org_id",
        "local_clusters",
        "max_local",
        F.coalesce(F.col("local_clusters") < F.col("max_local"), F.lit(False)).alias("can_add_local"),
        "remote_clusters",
        "max_remote",
        F.coalesce(F.col("remote_clusters") < F.col("max_remote"), F.lit(False)).alias("can_add_remote"),
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What happens to each incoming row when a live row may hold its key.

    ``incoming`` carries a unique ``request_id``. A row is inserted when no live
    row has its key and no earlier request asked for it; otherwise it gets the
    id of the live row, or the request that was inserted in its place.
    """
    keys = list(keys)
    absent = F.lit(None).cast("bigint")
    taken = existing.filter(_live()).select(*keys, F.col("id").alias("existing_id"), absent.alias("request"))
    asked = incoming.select(*keys, absent.alias("existing_id"), F.col("request_id").alias("request"))
    decided = taken.unionByName(asked).groupBy(*keys).agg(
        F.min("existing_id").alias("existing_id"), F.min("request").alias("first_request")
    )
    won = F.col("existing_id").isNull() & (F.col("request_id") == F.col("first_request"))
    return join_reduced(incoming, decided, keys).select(
        "request_id",
        *keys,
        won.alias("inserted"),
        "existing_id",
        F.when(F.col("existing_id").isNull() & ~won, F.col("first_request")).alias("same_as_request"),
    )


def rows_to_insert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows to append, one per key."""
    keys = list(keys)
    payload = [name for name in incoming.columns if name not in keys and name != "request_id"]
    first = incoming.groupBy(*keys).agg(F.min(F.struct("request_id", *payload)).alias("row")).select(*keys, "row.*")
    return first.join(existing.filter(_live()).select(*keys), keys, "left_anti")


def apply_updates(
    current: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str] = ("status", "status_detail"),
    touched: str | None = "last_updated",
) -> DataFrame:
    """Rows with their newest update; a soft delete is the state ``deleted``.

    ``updates`` carries the keys, updated_at, seq and the fields; an empty field
    keeps the old value. ``touched`` names the column that takes the time of the
    update. The newest update is found by a combining aggregate, so a hot key is
    reduced before it is shuffled.
    """
    keys, fields = list(keys), list(fields)
    newest = updates.groupBy(*keys).agg(
        F.max_by(F.struct("updated_at", *fields), F.struct("updated_at", "seq")).alias("update")
    )
    replaced = [*fields, *([touched] if touched else [])]
    kept = [name for name in current.columns if name not in {*keys, *replaced}]
    changed = [F.coalesce(f"update.{name}", name).alias(name) for name in fields]
    if touched:
        changed.append(F.coalesce("update.updated_at", touched).alias(touched))
    return join_reduced(current, newest, keys, "left").select(*keys, *kept, *changed)


def start_processes(processes: DataFrame, cluster_updates: DataFrame) -> DataFrame:
    """Processes after their clusters were updated; those of a starting cluster are starting.

    ``cluster_updates`` carries id, updated_at, seq and status.
    """
    newest = cluster_updates.groupBy(F.col("id").alias("cluster_id")).agg(
        F.max_by("status", F.struct("updated_at", "seq")).alias("cluster_status")
    )
    status = F.when(F.col("cluster_status") == "starting", F.lit("starting")).otherwise(F.col("status"))
    return join_reduced(processes, newest, ["cluster_id"], "left").withColumn("status", status).select(*processes.columns)


def _silence(now: Column) -> Column:
    """Whole seconds between the clock seconds of the last update and now."""
    return epoch_s(now) - epoch_s("last_updated")


def idle_clusters(clusters: DataFrame, now: Column, timeout_s: int = IDLE_TIMEOUT_S) -> DataFrame:
    """Running clusters not heard from for more than the timeout."""
    silent = _silence(now)
    return clusters.filter((F.col("status") == "running") & (silent > timeout_s)).select(
        F.col("id").alias("cluster_id"), "last_updated", silent.alias("idle_s"), format_interval(silent).alias("idle")
    )


def inactivate_idle(clusters: DataFrame, now: Column, timeout_s: int = IDLE_TIMEOUT_S) -> DataFrame:
    """All clusters, the idle ones being inactive now."""
    idle = (F.col("status") == "running") & (_silence(now) > timeout_s)
    return clusters.withColumn("status", F.when(idle, F.lit("inactive")).otherwise(F.col("status")))


def rollup_expression(total: Column, running: Column, stopped: Column, current: Column) -> Column:
    """Cluster state that follows from its process states; none keeps the current one."""
    return (
        F.when((total > 0) & (running == total), F.lit("running"))
        .when((total > 0) & (stopped == total), F.lit("terminated"))
        .otherwise(current)
    )


def process_counts(processes: DataFrame) -> DataFrame:
    """Processes of each cluster, and how many run or have stopped."""
    return processes.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("processes"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "stopped").alias("stopped"),
    )


def rollup_status(clusters: DataFrame, processes: DataFrame) -> DataFrame:
    """Running when all processes run, terminated when all stopped, else unchanged."""
    return (
        clusters.select(F.col("id").alias("cluster_id"), F.col("status").alias("old_status"))
        .join(process_counts(processes), "cluster_id", "left")
        .select(
            "cluster_id",
            "old_status",
            rollup_expression(F.col("processes"), F.col("running"), F.col("stopped"), F.col("old_status")).alias("status"),
        )
    )


def next_state(clusters: DataFrame, command: str) -> DataFrame:
    """The state each live cluster reports after a start or stop command."""
    if command == "stop":
        after = F.lit("terminating")
    elif command == "start":
        table = F.create_map(*[F.lit(part) for pair in START_TRANSITIONS.items() for part in pair])
        own = F.lit(None).cast("string")
        for (service, status), state in SERVICE_TRANSITIONS.items():
            own = F.when((F.col("service_name") == service) & (F.col("status") == status), state).otherwise(own)
        after = F.coalesce(own, F.try_element_at(table, F.col("status")), F.col("status"))
    else:
        raise ValueError(f"unknown command {command!r}")
    return clusters.filter(_live()).select(
        F.col("id").alias("cluster_id"), "service_name", "status", after.alias("next_status")
    )


def cluster_state(clusters: DataFrame, apps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of each cluster, a row each, with the cluster's applications by outcome.

    Formulas are ours: running applications are active, ``completed`` and
    ``succeeded`` are completed, ``failed`` is failed. A cluster without nodes
    has one row whose node columns are null.
    """
    counted = apps.groupBy("cluster_id").agg(
        F.count_if(F.col("status") == "running").alias("active_apps"),
        F.count_if(F.col("status").isin("completed", "succeeded")).alias("completed_apps"),
        F.count_if(F.col("status") == "failed").alias("failed_apps"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        clusters.select(F.col("id").alias("cluster_id"))
        .join(counted, "cluster_id", "left")
        .select(
            "cluster_id",
            *[F.coalesce(name, zero).alias(name) for name in ["active_apps", "completed_apps", "failed_apps"]],
        )
        .join(with_copies(nodes, ["cluster_id", "node_id", "host", "cpu_cores", "memory"]), "cluster_id", "left")
    )


SERVICE_OPTIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField(
                "services",
                T.ArrayType(
                    T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])
                ),
            ),
        ]
    )
)


def sandbox_options(sandboxes: DataFrame, repository: str) -> DataFrame:
    """Service options of each sandbox version, with image name and named ports.

    The image is named after the services of the option, ordered by first letter.
    """
    options = sandboxes.select(
        F.col("id").alias("sandbox_id"),
        "version",
        F.explode(F.from_json("service_options", SERVICE_OPTIONS)).alias("option"),
    )

    def by_letter(left: Column, right: Column) -> Column:
        a, b = F.substring(left["name"], 1, 1), F.substring(right["name"], 1, 1)
        return F.when(a < b, -1).when(a > b, 1).when(left["place"] < right["place"], -1).otherwise(1)

    placed = F.transform(
        "option.services", lambda service, place: F.named_struct(F.lit("name"), service["name"], F.lit("place"), place)
    )
    ordered = F.transform(F.array_sort(placed, by_letter), lambda service: service["name"])
    image = F.concat(F.lit(f"{repository}/"), F.array_join(ordered, "-"), F.lit(":"), F.col("version"))
    rows = options.select(
        "sandbox_id", "version", F.col("option.id").alias("option_id"), image.alias("image"),
        F.explode("option.services").alias("service"),
    )
    ports = F.lit(None)
    for (option, service), numbers in SANDBOX_PORTS.items():
        matches = F.lower("option_id") == option.lower()
        if service is not None:
            matches = matches & (F.lower("service.name") == service)
        known = [
            F.struct(
                F.lit(number).alias("port"), F.lit(name).alias("name"), F.lit(number not in PORTS_WITHOUT_PAGE).alias("has_page")
            )
            for number, name in numbers
        ]
        ports = F.when(matches, F.array(*known)).otherwise(ports)
    return rows.select(
        "sandbox_id",
        "version",
        "option_id",
        "image",
        F.col("service.name").alias("service_name"),
        F.col("service.version").alias("service_version"),
        ports.alias("ports"),
    )


def effective_conf(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """Settings of each cluster; user values win, and among them the last one.

    ``defaults`` has cluster_id, key, value; ``user`` has cluster_id, key, value,
    position. The choice is a combining aggregate, not a window.
    """
    ranked = defaults.select("cluster_id", "key", "value", F.lit(-1).cast("bigint").alias("position")).unionByName(
        user.select("cluster_id", "key", "value", F.col("position").cast("bigint").alias("position"))
    )
    return ranked.groupBy("cluster_id", "key").agg(F.max_by("value", "position").alias("value"))


def connection_inventory(connections: DataFrame, providers: DataFrame) -> DataFrame:
    """Connections of known providers, with category and creation time in epoch seconds."""
    kinds = providers.select(F.col("name").alias("provider"), F.col("category").alias("provider_category"))
    return connections.join(kinds, "provider").select(
        "id", "workspace_id", "name", "schema_version", "provider", "provider_category",
        epoch_s("dt_created").alias("created_s"),
    )


def provider_catalog(providers: DataFrame) -> DataFrame:
    """Connection providers."""
    return providers.select("name", "description", "category")


