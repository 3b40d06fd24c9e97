from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from check_queries import compare
from gridsight.functions.times import moment
from gridsight.operators import members, registry
from gridsight.operators.counting import with_copies


def now():
    return moment("2024-01-10 00:00:00")


@pytest.fixture
def clusters(spark):
    rows = [
        (1, "a", 10, "spark", "running", "sandbox", "2024-01-09 23:00:00", "2024-01-09 23:58:00"),
        (2, "b", 10, "kafka", "deleted", "sandbox", "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
        (3, "c", 11, "spark", "new", "yarn", "2024-01-08 00:00:00", "2024-01-09 23:00:00"),
        (4, "d", 11, "hadoop", "running", "sandbox-kubernetes", "2024-01-08 00:00:00", "2024-01-09 23:57:59"),
    ]
    schema = "id bigint, name string, workspace_id int, service_name string, status string, provider string, added string, updated string"
    return spark.createDataFrame(rows, schema).select(
        "id", "name", "workspace_id", "service_name", F.lit("1.0").alias("service_version"), F.lit("p").alias("provider_cluster_id"),
        "status", F.lit(None).cast("string").alias("status_detail"), "provider",
        F.col("added").cast("timestamp_ntz").alias("dt_added"), F.col("updated").cast("timestamp_ntz").alias("last_updated"),
    )


def test_views(clusters, rows):
    assert rows(registry.active_clusters(clusters, now()), "cluster_id", "created") == [(1, "1.0 h ago"), (3, "2 d ago"), (4, "2 d ago")]
    assert rows(registry.clusters_by_status(clusters, "running", now()), "cluster_id", "service_name") == [(1, "spark"), (4, "hadoop")]
    assert rows(registry.cluster_ids_by_service(clusters)) == [("hadoop", 0, [4]), ("spark", 0, [1, 3])]
    assert rows(registry.cluster_ids_by_service(clusters, 3)) == [("hadoop", 1, [4]), ("spark", 0, [1]), ("spark", 1, [3])]


def test_idle_is_strictly_longer_than_the_timeout(clusters, rows):
    assert rows(registry.idle_clusters(clusters, now(), 120), "cluster_id", "idle_s", "idle") == [(4, 121, "2 mins")]


def test_quota(spark, clusters, rows):
    workspaces = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id int, org_id int")
    plans = spark.createDataFrame([(1, 1, 5)], "org_id int, max_local int, max_remote int")
    assert rows(registry.quota_check(clusters, workspaces, plans)) == [(1, 1, 1, False, 1, 5, True), (2, 0, None, False, 0, None, False)]


def test_insert_if_absent(spark, clusters, rows):
    incoming = spark.createDataFrame(
        [(1, 10, "a"), (2, 10, "b"), (3, 10, "b"), (4, 12, "a")], "request_id bigint, workspace_id int, name string"
    )
    keys = ["workspace_id", "name"]
    assert rows(registry.insert_if_absent(clusters, incoming, keys), "request_id", "inserted", "existing_id", "same_as_request") == [
        (1, False, 1, None), (2, True, None, None), (3, False, None, 2), (4, True, None, None),
    ]
    assert rows(registry.rows_to_insert(clusters, incoming, keys), "request_id") == [(2,), (4,)]


def test_newest_update_wins_and_empty_detail_keeps_the_old_one(spark, clusters, rows):
    updates = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 1, "terminated", "x"), (1, datetime(2024, 1, 1), 2, "deleted", None)],
        "id bigint, updated_at timestamp_ntz, seq bigint, status string, status_detail string",
    )
    result = registry.apply_updates(clusters, updates, ["id"])
    assert rows(result, "id", "status", "status_detail") == [(1, "deleted", None), (2, "deleted", None), (3, "new", None), (4, "running", None)]


def test_process_updates(spark, rows):
    processes = spark.createDataFrame(
        [(1, "m", "running", 5), (1, "w", "running", 6), (2, "m", "running", 7)], "cluster_id bigint, name string, status string, pid bigint"
    )
    updates = spark.createDataFrame(
        [(1, "m", datetime(2024, 1, 1), 1, "stopped", None), (2, "m", datetime(2024, 1, 1), 1, "running", 9)],
        "cluster_id bigint, name string, updated_at timestamp_ntz, seq bigint, status string, pid bigint",
    )
    result = registry.apply_updates(processes, updates, ["cluster_id", "name"], ["status", "pid"], None)
    assert rows(result) == [(1, "m", "stopped", 5), (1, "w", "running", 6), (2, "m", "running", 9)]
    commands = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 1, "starting"), (2, datetime(2024, 1, 1), 1, "starting"), (2, datetime(2024, 1, 2), 1, "running")],
        "id bigint, updated_at timestamp_ntz, seq bigint, status string",
    )
    assert rows(registry.start_processes(processes, commands), "cluster_id", "name", "status") == [
        (1, "m", "starting"), (1, "w", "starting"), (2, "m", "running"),
    ]


def test_idle_clusters_become_inactive(clusters, rows):
    assert rows(registry.inactivate_idle(clusters, now()), "id", "status") == [(1, "running"), (2, "deleted"), (3, "new"), (4, "inactive")]


def test_rollup(spark, clusters, rows):
    processes = spark.createDataFrame(
        [(1, "m", "stopped"), (1, "w", "stopped"), (2, "m", "running"), (3, "m", "running"), (3, "w", "stopped")],
        "cluster_id bigint, name string, status string",
    )
    assert rows(registry.rollup_status(clusters, processes), "cluster_id", "status") == [
        (1, "terminated"), (2, "running"), (3, "new"), (4, "running"),
    ]


def test_next_state(spark, clusters, rows):
    assert rows(registry.next_state(clusters, "start"), "cluster_id", "next_status") == [(1, "running"), (3, "downloading"), (4, "running")]
    assert {row[0] for row in rows(registry.next_state(clusters, "stop"), "next_status")} == {"terminating"}
    with pytest.raises(ValueError):
        registry.next_state(clusters, "explode")


def test_a_large_key_gives_rows_of_the_same_kind(spark, tmp_path):
    customers = spark.range(1, 3001).selectExpr("id AS c_custkey", "'c' || id AS c_name", "CAST(7 AS INT) AS c_nationkey")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    parts = spark.range(1, 5001).selectExpr("id AS p_partkey", "'one' AS p_brand", "CAST(id AS INT) AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    engine = duckdb.connect()
    for name in ("customer", "part"):
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("host_inventory", "package_versions"):
        good, text = compare(spark, engine, str(tmp_path), name)
        assert good, text


def test_copies_are_counted(spark):
    copies = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), (None, 2), (None, 3)], "k string, v int")
    assert {tuple(row) for row in with_copies(copies, ["k", "v"]).collect()} == {(None, 2, 2), (None, 3, 1), ("a", 1, 2)}


def test_nodes_of_clusters(spark, clusters, rows):
    apps = spark.createDataFrame([(1, "running"), (1, "failed"), (2, "succeeded")], "cluster_id bigint, status string")
    nodes = spark.createDataFrame(
        [(1, "n1", "h1", 2, 10), (1, "n2", "h1", 2, 10), (1, "n2", "h1", 2, 10)],
        "cluster_id bigint, node_id string, host string, cpu_cores int, memory bigint",
    )
    found = registry.cluster_state(clusters, apps, nodes)
    assert {tuple(row) for row in found.select("cluster_id", "active_apps", "completed_apps", "failed_apps", "node_id", "copies").collect()} == {
        (1, 1, 0, 1, "n1", 1), (1, 1, 0, 1, "n2", 2), (2, 0, 1, 0, None, None), (3, 0, 0, 0, None, None), (4, 0, 0, 0, None, None),
    }


def test_packages_and_info(spark, clusters, rows):
    spark_table = spark.createDataFrame(
        [(1, "3.2.0", "2.12", "a 1\nb 2"), (3, "3.2.0", "2.12", None)],
        "cluster_id bigint, version string, scala_version string, configuration_params string",
    )
    hadoop = spark.createDataFrame([(4, "3.3.1")], "cluster_id bigint, version string")
    processes = spark.createDataFrame(
        [(1, "Worker", "h2", 2, "running"), (1, "Master", "h1", 1, "running"), (1, "worker", "h3", 3, "running")],
        "cluster_id bigint, name string, host_ip string, port int, status string",
    )
    tables = {"spark": spark_table, "hadoop": hadoop}
    package = registry.cluster_packages(clusters, tables, processes).orderBy("process_name").collect()
    assert [(row["cluster_id"], row["user_config"], row["process_name"], row["copies"]) for row in package] == [
        (1, ["a 1", "b 2"], name, 1) for name in ("Master", "Worker", "worker")
    ]
    info = registry.cluster_info(clusters, tables, processes, ["master", "WORKER"])
    assert rows(info, "cluster_id", "scala_version", "process_count", "master_count", "worker_count") == [
        (1, "2.12", 3, 1, 2), (3, "2.12", 0, 0, 0), (4, None, 0, 0, 0),
    ]


def test_sandbox_images_are_named_by_first_letter(spark, rows):
    options = '[{"id":"Spark with Kafka","services":[{"name":"spark","version":"1"},{"name":"kafka","version":"2"},{"name":"samza","version":"3"}]}]'
    df = spark.createDataFrame([(1, "v1", options)], "id bigint, version string, service_options string")
    result = registry.sandbox_options(df, "repo")
    assert {row[0] for row in rows(result, "image")} == {"repo/kafka-spark-samza:v1"}
    assert result.count() == 3


def test_sandbox_ports_have_names(spark):
    options = '[{"id":"spark on yarn","services":[{"name":"Hadoop","version":"3"},{"name":"other","version":"1"}]}]'
    df = spark.createDataFrame([(1, "v1", options)], "id bigint, version string, service_options string")
    found = {row["service_name"]: row["ports"] for row in registry.sandbox_options(df, "repo").collect()}
    assert found["other"] is None
    assert [tuple(port) for port in found["Hadoop"]] == [
        (8088, "Resource Manager", True), (50070, "HDFS Web UI", True), (50075, "Data Node", True), (9000, "HDFS Service", False),
    ]


def test_effective_conf(spark, rows):
    defaults = spark.createDataFrame([(1, "a", "d"), (1, "b", "d")], "cluster_id bigint, key string, value string")
    user = spark.createDataFrame([(1, "a", "u1", 0), (1, "a", "u2", 1)], "cluster_id bigint, key string, value string, position bigint")
    assert rows(registry.effective_conf(defaults, user)) == [(1, "a", "u2"), (1, "b", "d")]


def test_permissions_need_the_right_subject(spark, rows):
    roles = spark.createDataFrame(
        [(1, "WORKSPACE.manage:bogus"), (2, "org.manage"), (3, "workspace.read")], "role_id int, access_policies string"
    )
    held = spark.createDataFrame(
        [(1, 1, "workspace", 5), (1, 2, "org", 9), (2, 3, "workspace", 5), (3, 1, "workspace", 6)],
        "member_id bigint, role_id int, subject_type string, subject_id int",
    )
    policies = members.member_policies(roles, held)
    assert rows(policies, "member_id", "policy") == [(1, "org.manage"), (1, "workspace.manage"), (2, "workspace.read"), (3, "workspace.manage")]
    profiles = spark.createDataFrame([(1, 8, 5), (2, 8, 5), (3, 8, 5), (4, 8, 5)], "member_id bigint, org_id int, workspace_id int")
    assert rows(members.permission_matrix(profiles, policies), "member_id", "can_view", "can_manage", "can_manage_org") == [
        (1, True, True, False), (2, True, False, False), (3, False, False, False), (4, False, False, False),
    ]


def test_key_validity_and_tokens(spark, rows):
    orgs = spark.sql(
        "SELECT 1 AS id, 'a' AS name, timestamp_ntz'2024-01-05 12:00:00' AS dt_created, 6 AS validity_days UNION ALL "
        "SELECT 2, 'b', timestamp_ntz'2024-01-04 00:00:00', 6"
    )
    assert rows(members.org_key_validity(orgs, now())) == [(1, "a", "1.5 d"), (2, "b", "0 days")]
    tokens = spark.sql("SELECT 1 AS id, 7 AS member_id, timestamp_ntz'2024-01-10 00:00:00' AS expiry UNION ALL SELECT 2, 8, timestamp_ntz'2024-01-10 00:00:01'")
    result = members.unexpired_tokens(tokens, now())
    assert rows(result, "member_id") == [(8,)] and "id" not in result.columns


def test_hadoop_starts_again_from_its_own_failures(spark):
    states = [("hadoop", "terminated_with_errors"), ("hadoop", "failed_while_downloading"), ("spark", "terminated_with_errors")]
    rows = [(place, service, state) for place, (service, state) in enumerate(states)]
    live = spark.createDataFrame(rows, "id bigint, service_name string, status string")
    found = registry.next_state(live, "start").orderBy("cluster_id").collect()
    assert [row["next_status"] for row in found] == ["starting", "downloading", "downloading"]
