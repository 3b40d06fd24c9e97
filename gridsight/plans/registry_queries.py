"""Cluster, member, catalog and configuration queries."""

from pyspark.sql import functions as F

from ..functions import names, parsing
from ..functions.times import moment
from ..operators import members, query as query_ops, registry
from . import bindings as b
from .binding_sql import NOW, elapsed, interval_ms, interval_ms_days, interval_s, pick
from .catalogue import listed, query

_VIEW = (
    "SELECT id AS cluster_id, workspace_id, name, service_name, service_version, provider_cluster_id, provider, status, "
    f"({interval_ms(elapsed('dt_added', NOW))}) || ' ago' AS created FROM clusters "
)


@query("R1 X2 X5", _VIEW + "WHERE status <> 'deleted'", ["clusters"])
def active_clusters(spark, folder):
    return registry.active_clusters(b.clusters(spark, folder), b.now())


@query("R2 X2", _VIEW + "WHERE status = 'terminated'", ["clusters"])
def clusters_by_status(spark, folder):
    return registry.clusters_by_status(b.clusters(spark, folder), "terminated", b.now())


@query(
    "R3",
    "SELECT service_name, id // 1000 AS block, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS cluster_ids FROM clusters "
    "WHERE status <> 'deleted' GROUP BY 1, 2",
    ["clusters"],
)
def cluster_ids_by_service(spark, folder):
    result = registry.cluster_ids_by_service(b.clusters(spark, folder))
    return result.withColumn("cluster_ids", listed(F.col("cluster_ids")))


@query(
    "R4",
    "SELECT cluster_id, workspace_id, c.name AS cluster_name, c.status, c.service_name, version, scala_version, "
    "coalesce(replace(configuration_params, chr(10), '|'), '') AS user_config, p.name AS process_name, host_ip, port, count(*) AS copies "
    "FROM processes p JOIN services s USING (cluster_id) JOIN clusters c ON c.id = cluster_id AND c.service_name = s.service_name "
    "WHERE c.status <> 'deleted' GROUP BY ALL",
    ["clusters", "services", "processes"],
)
def cluster_packages(spark, folder):
    result = registry.cluster_packages(
        b.clusters(spark, folder), b.service_tables(spark, folder), b.processes(spark, folder)
    )
    return result.withColumn("user_config", listed(F.col("user_config"), "|"))


@query(
    "R5",
    "SELECT id AS cluster_id, workspace_id, c.name AS cluster_name, c.service_name, version, scala_version, c.status, "
    "CAST(NULL AS VARCHAR) AS status_detail, count(p.pid) AS process_count, count(*) FILTER (p.name = 'Master') AS master_count, "
    "count(*) FILTER (p.name = 'Worker') AS worker_count FROM clusters c JOIN services s ON s.cluster_id = c.id LEFT JOIN processes p "
    "ON p.cluster_id = c.id GROUP BY ALL",
    ["clusters", "services", "processes"],
)
def cluster_info(spark, folder):
    return registry.cluster_info(
        b.clusters(spark, folder), b.service_tables(spark, folder), b.processes(spark, folder), ["MASTER", "worker"]
    )


@query(
    "R6",
    "SELECT cluster_id, workspace_id, p.name, host_ip, port, p.status FROM processes p JOIN clusters c ON p.cluster_id = c.id "
    "WHERE p.name ILIKE 'mas%'",
    ["processes", "clusters"],
)
def find_process(spark, folder):
    return registry.find_process(b.processes(spark, folder), b.clusters(spark, folder), "mas%")


@query(
    "R7",
    "SELECT workspace_id, 'host-' || workspace_id AS host, '10.0.0.' || workspace_id AS host_ip, 'running' AS status, "
    f"CAST(epoch({NOW} - to_hours(id % 1000)) AS BIGINT) AS added, provider, id AS cluster_id, service_name, service_version, "
    "CAST(1 AS BIGINT) AS copies FROM clusters WHERE status <> 'deleted'",
    ["clusters"],
)
def host_inventory(spark, folder):
    return registry.host_inventory(b.hosts(spark, folder), b.clusters(spark, folder))


@query(
    "R8",
    "SELECT org_id, local_clusters, max_local, coalesce(local_clusters < max_local, false) AS can_add_local, remote_clusters, "
    "max_remote, coalesce(remote_clusters < max_remote, false) AS can_add_remote FROM (SELECT org_id, count(*) FILTER (provider IN "
    "('sandbox', 'sandbox-docker') AND status <> 'deleted') AS local_clusters, count(*) FILTER (provider IN ('spark-standalone', "
    "'k8s', 'yarn')) AS remote_clusters FROM workspaces w LEFT JOIN clusters c ON c.workspace_id = w.id GROUP BY org_id) LEFT JOIN "
    "(SELECT r_regionkey AS org_id, CAST(r_regionkey * 50 AS INTEGER) AS max_local, CAST(40 AS INTEGER) AS max_remote FROM region "
    "WHERE r_regionkey <> 4) USING (org_id)",
    ["workspaces", "clusters"],
)
def quota_check(spark, folder):
    return registry.quota_check(b.clusters(spark, folder), b.workspaces(spark, folder), b.plans(spark, folder))


@query(
    "R9",
    "SELECT request_id, workspace_id, name, inserted, existing_id, CASE WHEN existing_id IS NULL AND NOT inserted THEN first_request END "
    "AS same_as_request FROM (SELECT request_id, workspace_id, name, existing_id, first_request, existing_id IS NULL AND request_id = "
    "first_request AS inserted FROM (SELECT *, min(request_id) OVER (PARTITION BY workspace_id, name) AS first_request FROM requests) r "
    "LEFT JOIN (SELECT workspace_id, name, min(id) AS existing_id FROM clusters WHERE status <> 'deleted' GROUP BY ALL) c "
    "USING (workspace_id, name))",
    ["requests", "clusters"],
)
def insert_if_absent(spark, folder):
    return registry.insert_if_absent(b.clusters(spark, folder), b.cluster_requests(spark, folder), ["workspace_id", "name"])


@query(
    "R9",
    "SELECT workspace_id, name, min(request_id) AS request_id FROM requests r WHERE NOT EXISTS (SELECT 1 FROM clusters c WHERE "
    "c.workspace_id = r.workspace_id AND c.name = r.name AND c.status <> 'deleted') GROUP BY ALL",
    ["requests", "clusters"],
)
def rows_to_insert(spark, folder):
    return registry.rows_to_insert(
        b.clusters(spark, folder), b.cluster_requests(spark, folder).drop("provider"), ["workspace_id", "name"]
    )


@query(
    "R9",
    "SELECT request_id, workspace_id, service_name, existing_id IS NULL AND request_id = first_request AS inserted, existing_id, CASE WHEN "
    "existing_id IS NULL AND request_id <> first_request THEN first_request END AS same_as_request FROM (SELECT *, min(request_id) OVER "
    "(PARTITION BY workspace_id, service_name) AS first_request FROM (SELECT c_custkey AS request_id, CAST(c_nationkey + c_custkey % 2 * 100 "
    f"AS BIGINT) AS workspace_id, {pick('c_custkey', b.SERVICES)} AS service_name FROM customer)) r LEFT JOIN (SELECT workspace_id, "
    "service_name, min(id) AS existing_id FROM clusters WHERE status <> 'deleted' AND provider = 'local' GROUP BY ALL) c "
    "USING (workspace_id, service_name)",
    ["clusters"],
)
def one_service_per_workspace(spark, folder):
    local = b.clusters(spark, folder).filter(F.col("provider") == "local")
    return registry.insert_if_absent(local, b.service_requests(spark, folder), ["workspace_id", "service_name"])


@query(
    "R10",
    "SELECT id, name, workspace_id, service_name, coalesce(u.status, c.status) AS status, u.status_detail, "
    "coalesce(u.updated_at, last_updated) AS last_updated FROM clusters c LEFT JOIN (SELECT o_custkey AS id, o_orderdate AS updated_at, "
    + pick("o_orderkey", ["running", "terminated", "deleted", "starting"])
    + " AS status, CASE WHEN o_orderkey % 3 <> 0 THEN 'u' || o_orderkey END AS status_detail FROM orders QUALIFY row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) u USING (id)",
    ["clusters"],
)
def apply_updates(spark, folder):
    current = b.clusters(spark, folder).select(
        "id", "name", "workspace_id", "service_name", "status", "status_detail", "last_updated"
    )
    return registry.apply_updates(current, b.cluster_updates(spark, folder), ["id"])


@query(
    "R10",
    "SELECT p.cluster_id, p.name, host_ip, port, coalesce(u.status, p.status) AS status, coalesce(u.pid, p.pid) AS pid FROM processes p "
    f"LEFT JOIN (SELECT o_custkey AS cluster_id, {pick('o_orderkey // 3', b.PROCESS_NAMES)} AS name, "
    f"{pick('o_orderkey', ['running', 'stopped'])} AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS pid FROM orders QUALIFY "
    "row_number() OVER (PARTITION BY o_custkey, o_orderkey // 3 % 3 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) u "
    "ON u.cluster_id = p.cluster_id AND u.name = p.name",
    ["processes"],
)
def apply_process_updates(spark, folder):
    return registry.apply_updates(
        b.processes(spark, folder), b.process_updates(spark, folder), ["cluster_id", "name"], ["status", "pid"], None
    )


@query(
    "R10",
    "SELECT p.cluster_id, name, host_ip, port, CASE WHEN u.status = 'starting' THEN 'starting' ELSE p.status END AS status, pid FROM "
    "processes p LEFT JOIN (SELECT o_custkey AS cluster_id, "
    + pick("o_orderkey", ["running", "terminated", "deleted", "starting"])
    + " AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) u "
    "ON u.cluster_id = p.cluster_id",
    ["processes"],
)
def start_processes(spark, folder):
    return registry.start_processes(b.processes(spark, folder), b.cluster_updates(spark, folder))


@query(
    "R11",
    f"SELECT id, CASE WHEN status = 'running' AND date_diff('second', last_updated, {NOW}) > 120 THEN 'inactive' ELSE status END AS status "
    "FROM clusters",
    ["clusters"],
)
def inactivate_idle(spark, folder):
    return registry.inactivate_idle(b.clusters(spark, folder), b.now()).select("id", "status")


@query(
    "R11 X1",
    f"SELECT id AS cluster_id, last_updated, idle_s, {interval_s('idle_s')} AS idle FROM (SELECT *, "
    f"date_diff('second', last_updated, {NOW}) AS idle_s FROM clusters) WHERE status = 'running' AND idle_s > 120",
    ["clusters"],
)
def idle_clusters(spark, folder):
    return registry.idle_clusters(b.clusters(spark, folder), b.now(), 120)


@query(
    "R12",
    "SELECT id AS cluster_id, c.status AS old_status, CASE WHEN bool_and(p.status = 'running') THEN 'running' WHEN "
    "bool_and(p.status = 'stopped') THEN 'terminated' ELSE c.status END AS status FROM clusters c LEFT JOIN processes p ON "
    "p.cluster_id = c.id GROUP BY id, c.status",
    ["clusters", "processes"],
)
def rollup_status(spark, folder):
    return registry.rollup_status(b.clusters(spark, folder), b.processes(spark, folder))


@query(
    "R13",
    "SELECT id AS cluster_id, service_name, status, CASE status WHEN 'new' THEN 'downloading' WHEN 'terminated_with_errors' THEN "
    "'downloading' WHEN 'terminated' THEN 'starting' WHEN 'inactive' THEN 'starting' ELSE status END AS next_status FROM clusters "
    "WHERE status <> 'deleted'",
    ["clusters"],
)
def next_state_on_start(spark, folder):
    return registry.next_state(b.clusters(spark, folder), "start")


@query(
    "R13",
    "SELECT id AS cluster_id, service_name, status, 'terminating' AS next_status FROM clusters WHERE status <> 'deleted'",
    ["clusters"],
)
def next_state_on_stop(spark, folder):
    return registry.next_state(b.clusters(spark, folder), "stop")


@query(
    "R14",
    "SELECT member_id, org_id, r_name AS org_name, lower(r_name) AS org_slug, workspace_id, n_name AS workspace_name, web_theme, "
    "desktop_theme FROM profiles JOIN region ON r_regionkey = org_id JOIN nation ON n_nationkey = workspace_id",
    ["profiles"],
)
def member_profiles(spark, folder):
    return members.member_profiles(b.member_profiles(spark, folder), b.orgs(spark, folder), b.workspaces(spark, folder))


@query("R15", "SELECT member_id, subject_type, subject_id, policy FROM policies", ["policies"])
def member_policies(spark, folder):
    return members.member_policies(b.roles(spark, folder), b.member_roles(spark, folder))


@query(
    "R16",
    "SELECT p.member_id, org_id, workspace_id, coalesce(bool_or(subject_type = 'workspace' AND subject_id = workspace_id AND policy IN "
    "('workspace.manage', 'workspace.read')), false) AS can_view, coalesce(bool_or(subject_type = 'workspace' AND subject_id = "
    "workspace_id AND policy = 'workspace.manage'), false) AS can_manage, coalesce(bool_or(subject_type = 'org' AND subject_id = org_id "
    "AND policy = 'org.manage'), false) AS can_manage_org FROM profiles p LEFT JOIN policies USING (member_id) GROUP BY ALL",
    ["profiles", "policies"],
)
def permission_matrix(spark, folder):
    policies = members.member_policies(b.roles(spark, folder), b.member_roles(spark, folder))
    return members.permission_matrix(b.member_profiles(spark, folder), policies)


@query(
    "R17 X4",
    f"SELECT org_id, name, CASE WHEN left_ms > 0 THEN {interval_ms_days('left_ms')} ELSE '0 days' END AS time_left FROM (SELECT "
    "r_regionkey AS org_id, r_name AS name, (25 * 24 - r_regionkey * 240 - 5) * CAST(3600000 AS BIGINT) AS left_ms FROM region)",
)
def org_key_validity(spark, folder):
    return members.org_key_validity(b.orgs(spark, folder), b.now())


@query(
    "R18",
    "SELECT o_custkey AS member_id, o_orderdate + INTERVAL 30 DAY AS expiry FROM orders WHERE o_orderdate + INTERVAL 30 DAY > "
    "TIMESTAMP '1998-01-01 00:00:00'",
)
def unexpired_tokens(spark, folder):
    return members.unexpired_tokens(b.tokens(spark, folder), moment("1998-01-01 00:00:00"))


@query(
    "R19",
    "SELECT status, count(*) AS n FROM (SELECT CASE WHEN raw IN ('running', 'stopped', 'failed', 'not running') THEN raw ELSE 'unknown' "
    f"END AS status FROM (SELECT {pick('o_orderkey', b.RAW_STATES)} AS raw FROM orders)) GROUP BY status",
)
def normalised_states(spark, folder):
    status = names.normalise(F.col("raw"), "run_status").alias("status")
    return b.raw_states(spark, folder).groupBy(status).agg(F.count(F.lit(1)).alias("n"))


@query(
    "R20",
    "SELECT address, CASE address WHEN 'spark://h:7077' THEN 'spark-standalone' WHEN 'yarn' THEN 'yarn' WHEN 'YARN' THEN 'yarn' "
    f"WHEN 'k8s://h' THEN 'k8s' END AS provider, count(*) AS n FROM (SELECT {pick('c_custkey', b.RAW_MANAGERS)} AS address "
    "FROM customer) GROUP BY 1",
)
def providers_by_address(spark, folder):
    managers = b.raw_managers(spark, folder)
    return managers.groupBy("address", names.provider_of(F.col("address")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "R21 X5",
    f"SELECT org_id, id AS workspace_id, name, ({interval_ms(elapsed('dt_created', NOW))}) || ' ago' AS created FROM workspaces",
    ["workspaces"],
)
def workspaces_with_age(spark, folder):
    return members.workspaces_with_age(b.workspaces(spark, folder), b.now())


@query(
    "R22",
    "SELECT s_suppkey AS member_id, s_name AS name, lower(s_name) || '@example.org' AS email, provider_id FROM supplier JOIN (VALUES "
    "(0, 'credentials'), (1, 'github')) v(k, provider_id) ON k <= s_suppkey % 2",
)
def login_directory(spark, folder):
    logins = b.logins(spark, folder)
    user_login = logins.select("member_id", F.col("id").alias("login_id"))
    return members.login_directory(b.members(spark, folder), user_login, logins.select("id", "provider_id"))


@query(
    "R23",
    "SELECT cluster_id, active_apps, completed_apps, failed_apps, node_id, host, cpu_cores, memory, copies FROM (SELECT id AS cluster_id, "
    "count(*) FILTER (o_orderstatus = 'O') AS active_apps, count(*) FILTER (o_orderstatus = 'F') AS completed_apps, count(*) FILTER "
    "(o_orderstatus = 'P') AS failed_apps FROM clusters LEFT JOIN orders ON o_custkey = id GROUP BY id) LEFT JOIN (SELECT s_suppkey AS "
    "cluster_id, 'n' || s_suppkey || '-' || k AS node_id, 'host-' || (s_suppkey % 40) AS host, s_suppkey % 8 + 1 AS cpu_cores, "
    "(k + 1) * CAST(1073741824 AS BIGINT) AS memory, CAST(1 AS BIGINT) AS copies FROM supplier, (VALUES (0), (1)) v(k)) USING (cluster_id)",
    ["clusters"],
)
def cluster_state(spark, folder):
    return registry.cluster_state(b.clusters(spark, folder), b.cluster_apps(spark, folder), b.cluster_nodes(spark, folder))


@query(
    "R24",
    "SELECT p_partkey AS sandbox_id, 'v' || (p_partkey % 5) AS version, option_id, image || ':v' || (p_partkey % 5) AS image, "
    "service_name, CASE WHEN option_id = 'Spark Standalone' THEN '3.' || (p_partkey % 4) || '.0' WHEN service_name = 'spark' THEN "
    "'3.2.0' ELSE '3.3.' || (p_partkey % 3) END AS service_version, ports FROM part JOIN (VALUES "
    "('Spark Standalone', 'registry/spark', 'spark', '18080 Spark History Server true,8080 Master Web UI true'), "
    "('Spark on YARN', 'registry/hadoop-spark', 'spark', '18080 Spark History Server true'), "
    "('Spark on YARN', 'registry/hadoop-spark', 'hadoop', '8088 Resource Manager true,50070 HDFS Web UI true,50075 Data Node true,"
    "9000 HDFS Service false')) v(option_id, image, service_name, ports) "
    "ON option_id = 'Spark Standalone' OR p_partkey % 2 = 0",
)
def sandbox_options(spark, folder):
    result = registry.sandbox_options(b.sandboxes(spark, folder), "registry")
    fields = ["port", "name", "has_page"]
    ports = F.transform("ports", lambda entry: F.concat_ws(" ", *[entry[field].cast("string") for field in fields]))
    return result.withColumn("ports", listed(ports))


@query(
    "X14 X15",
    "SELECT cluster_id, key, arg_max(value, position) AS value FROM (SELECT p_partkey % 50 AS cluster_id, 'spark.k' || (p_size % 10) AS "
    "key, CAST(p_size AS VARCHAR) AS value, p_partkey AS position FROM part WHERE p_partkey % 33 <> 0 AND p_partkey % 20 <> 0 UNION ALL "
    "SELECT c, key, value, -1 FROM (SELECT DISTINCT p_partkey % 50 AS c FROM part), (VALUES ('spark.k0', 'default0'), ('spark.k1', "
    "'default1'), ('spark.master', 'local')) v(key, value)) GROUP BY ALL",
)
def effective_conf(spark, folder):
    lines = b.conf_lines(spark, folder).withColumn("setting", parsing.parse_conf_line(F.col("line")))
    user = lines.filter(F.col("setting").isNotNull()).select("cluster_id", "setting.key", "setting.value", "position")
    return registry.effective_conf(b.conf_defaults(spark, folder), user)


@query(
    "X18",
    "SELECT p_partkey AS id, 'spark-submit|--name|job-' || p_partkey || '|--class|org.app.' || p_type || '|--executor-memory|' || "
    "(p_size % 8 + 1) || 'g|--driver-memory|' || (p_size % 4 + 1) || 'g|--executor-cores|' || (p_size % 3 + 1) || '|--num-executors|' "
    "|| (p_size % 5 + 1) || CASE WHEN p_partkey % 2 = 0 THEN '|--conf|spark.k=' || p_size || '|--conf|spark.ui.enabled=false' ELSE '' END "
    "|| '|/jobs/' || p_partkey || '.jar|--day|' || (p_partkey % 31 + 1) || '|--full' AS command FROM part",
)
def submit_commands(spark, folder):
    return b.job_configs(spark, folder).select("id", listed(parsing.submit_command("job"), "|").alias("command"))


@query(
    "C3",
    "SELECT id, name, version, CAST(split_part(version, '.', 1) AS INTEGER) AS major, CAST(split_part(version, '.', 2) AS INTEGER) AS "
    "minor, TRY_CAST(split_part(version, '.', 3) AS INTEGER) AS patch FROM packages",
    ["packages"],
)
def parsed_versions(spark, folder):
    return query_ops.parsed_versions(b.packages(spark, folder))


@query(
    "C4",
    "SELECT name, version, count(*) AS copies FROM packages WHERE NOT is_deprecated GROUP BY ALL",
    ["packages"],
)
def package_versions(spark, folder):
    return query_ops.package_versions(b.packages(spark, folder))


@query(
    "C5",
    "SELECT s_suppkey AS id, s_nationkey AS workspace_id, s_name AS name, CAST(1 AS INTEGER) AS schema_version, provider, "
    "provider_category, CAST(1706659200 - (s_suppkey % 1000) * 3600 AS BIGINT) AS created_s FROM supplier JOIN (VALUES (0, 'postgres', "
    "'rdbms'), (1, 'mysql', 'rdbms'), (2, 's3', 'fs'), (3, 'cassandra', 'nosql')) v(k, provider, provider_category) ON s_suppkey % 5 = k",
)
def connection_inventory(spark, folder):
    return registry.connection_inventory(b.connections(spark, folder), b.connection_providers(spark, folder))


@query(
    "C6",
    f"SELECT {pick('r_regionkey', b.PROVIDER_KINDS)} AS name, r_name AS description, "
    f"{pick('r_regionkey', ['rdbms', 'rdbms', 'fs', 'nosql', 'rdbms'])} AS category FROM region",
)
def provider_catalog(spark, folder):
    return registry.provider_catalog(b.connection_providers(spark, folder))


_KINDS = ["query", "update", "update", "query", "invalid", "query", "invalid"]


@query("Q2", f"SELECT kind, count(*) AS statements FROM (SELECT {pick('p_partkey', _KINDS)} AS kind FROM part) GROUP BY kind")
def statement_counts(spark, folder):
    return query_ops.statement_counts(b.statements(spark, folder), "statement")


_ANY_SPACE = ["query", "update", "update", "query", "invalid", "update", "invalid"]


@query("Q2", f"SELECT p_partkey AS id, {pick('p_partkey', _ANY_SPACE)} AS kind FROM part")
def statement_kinds_any_space(spark, folder):
    return query_ops.statement_kind(b.statements(spark, folder), "statement", any_space=True).select("id", "kind")


USER_SQL = (
    "SELECT n_name, count(*) AS orders, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, "
    "max(o_orderdate) AS newest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name HAVING count(*) > 5"
)


@query("Q1", USER_SQL)
def user_query(spark, folder):
    tables = {name: b.table(spark, folder, name) for name in ("orders", "customer", "nation")}
    return query_ops.run_query(spark, tables, USER_SQL.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query("S12", "SELECT to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, c_nationkey := c_nationkey)) AS json FROM customer")
def json_rows(spark, folder):
    return query_ops.to_json_rows(b.table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"))
