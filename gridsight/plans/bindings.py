"""The test tables in the shapes the operators take.

Every binding is a projection of whole tables, so the work grows with them.
``NOW`` stands for the present. The same bindings in SQL are in
``binding_sql``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import epoch_ms, moment

NOW = "2024-01-31 00:00:00"
HISTORY_NOW_MS = 1004572800000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def now() -> Column:
    return moment(NOW)


def pick(index: Column, values: Sequence[str | None]) -> Column:
    """The value whose place is the index, counted around."""
    place = (index % len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(value).cast("string") for value in values]), place)


def rounded(value: Column) -> Column:
    return F.round(value).cast("bigint")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])


def topic_log_of(events: DataFrame) -> DataFrame:
    """Offsets are event ids: they rise within a partition and have gaps, as after compaction."""
    return events.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition_id"),
        F.col("event_id").alias("log_offset"),
        epoch_ms("ts").alias("ts_ms"),
        F.col("user_id").cast("string").alias("msg_key"),
        F.col("props").alias("message"),
        F.length("props").cast("bigint").alias("size"),
    )


def topic_log(spark: SparkSession, folder: str) -> DataFrame:
    return topic_log_of(table(spark, folder, "events"))


def replicas(spark: SparkSession, folder: str) -> DataFrame:
    """Two replicas of each partition; the second of partition 3 lags behind."""
    sizes = topic_log(spark, folder).groupBy("topic", "partition_id").agg(F.sum("size").alias("size"))
    return sizes.select("topic", "partition_id", "size", F.explode(F.array(F.lit(0), F.lit(1))).alias("r")).select(
        "topic",
        "partition_id",
        ((F.col("partition_id") + F.col("r")) % 3).alias("broker_id"),
        (F.col("r") == 0).alias("leader"),
        ((F.col("r") == 0) | (F.col("partition_id") != 3)).alias("in_sync"),
        "size",
    )


def brokers(spark: SparkSession, folder: str) -> DataFrame:
    return replicas(spark, folder).select("broker_id").distinct().select(
        F.lit("main").alias("kafka_cluster"),
        "broker_id",
        text("b", F.col("broker_id"), ":9092").alias("address"),
        text("r", F.col("broker_id")).alias("rack"),
    )


def assignments(offsets: DataFrame) -> DataFrame:
    """Every partition belongs to one member of each of the groups g0, g1 and g2."""
    groups = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("g")
    return offsets.select("topic", "partition_id", "end_offset", groups).select(
        text("g", F.col("g")).alias("group_id"),
        text("client-", F.col("partition_id") % 2).alias("member"),
        "topic",
        "partition_id",
        "g",
        "end_offset",
    )


def committed(offsets: DataFrame) -> DataFrame:
    """Group g2 has not committed anything for partition 3."""
    return assignments(offsets).filter(~((F.col("g") == 2) & (F.col("partition_id") == 3))).select(
        "group_id",
        "topic",
        "partition_id",
        F.call_function("div", F.col("end_offset") * (F.col("g") + 1), F.lit(4)).alias("committed_offset"),
    )


def consumer_groups(offsets: DataFrame) -> DataFrame:
    """The three groups with members, and an empty one."""
    groups = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g")
    return offsets.select(groups).distinct().select(
        text("g", F.col("g")).alias("group_id"),
        (F.col("g") % 3).alias("coordinator"),
        F.when(F.col("g") == 3, F.lit("Empty")).otherwise(F.lit("Stable")).alias("state"),
    )


TOPIC_SETTINGS = [
    ("cleanup.policy", "delete", "LIST", "DEFAULT_CONFIG"),
    ("retention.ms", "604800000", "LONG", "DYNAMIC_TOPIC_CONFIG"),
    ("min.insync.replicas", "1", "INT", "DEFAULT_CONFIG"),
]


def topic_configs(spark: SparkSession, folder: str) -> DataFrame:
    settings = F.array(
        *[
            F.struct(*[F.lit(part).alias(name) for name, part in zip(("config", "value", "type", "source"), setting)])
            for setting in TOPIC_SETTINGS
        ]
    )
    topics = table(spark, folder, "events").select(F.col("event_type").alias("topic")).distinct()
    return topics.select("topic", F.inline(settings))


def files(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    name = (
        F.when(doc % 50 == 0, text(doc, ".txt"))
        .when(doc % 97 == 0, text(F.col("source"), "/", F.col("lang"), "/", doc, "/"))
        .otherwise(text(F.col("source"), "/", F.col("lang"), "/", doc, ".txt"))
    )
    return table(spark, folder, "documents").select(
        name.alias("name"),
        F.col("n_chars").alias("size"),
        (doc + 1700000000).alias("last_modified"),
        text("owner", doc % 3).alias("owner"),
    )


def hdfs_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One status answer per document: a listing of two entries, or a single file."""
    doc = F.col("doc_id")

    def entry(place: int) -> Column:
        return F.struct(
            (doc % 5 * 1000000000000).alias("accessTime"),
            (doc % 3 * 67108864).alias("blockSize"),
            F.lit("supergroup").alias("group"),
            (F.lit(0).cast("bigint") if place == 1 else F.col("n_chars") * (doc % 1000 + 1)).alias("length"),
            (doc + 1700000000000).alias("modificationTime"),
            text("owner", doc % 3).alias("owner"),
            text("part-", doc, f"-{place}").alias("pathSuffix"),
            F.lit("644").alias("permission"),
            F.lit(0 if place == 1 else 3).alias("replication"),
            F.lit("DIRECTORY" if place == 1 else "FILE").alias("type"),
        )

    listing = F.to_json(F.struct(F.struct(F.array(entry(0), entry(1)).alias("FileStatus")).alias("FileStatuses")))
    single = F.to_json(F.struct(entry(0).alias("FileStatus")))
    return table(spark, folder, "documents").select(
        text("/", F.col("source"), "/", F.col("lang")).alias("directory"),
        F.when(doc % 4 == 0, single).otherwise(listing).alias("json"),
    )


SERVICES = ["spark", "kafka", "hadoop"]
VERSIONS = ["3.2.0", "2.8.1", "3.3.1"]
CLUSTER_STATES = ["new", "downloading", "starting", "running", "terminated", "inactive", "deleted"]
PROVIDERS = ["local", "sandbox", "sandbox-docker", "spark-standalone", "yarn"]


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("workspace_id"),
        pick(key, SERVICES).alias("service_name"),
        pick(key, VERSIONS).alias("service_version"),
        text("pc-", key).alias("provider_cluster_id"),
        pick(key, CLUSTER_STATES).alias("status"),
        F.lit(None).cast("string").alias("status_detail"),
        pick(key, PROVIDERS).alias("provider"),
        F.timestamp_add("HOUR", -(key % 20000), now()).alias("dt_added"),
        F.timestamp_add("SECOND", -(key % 300), now()).alias("last_updated"),
    )


def service_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Spark clusters have a Scala version and configuration, Kafka ones a Scala version."""
    key = F.col("c_custkey")
    customer = table(spark, folder, "customer")
    conf = F.when(key % 5 != 0, text("spark.executor.cores 2\nspark.executor.memory ", key % 8 + 1, "g"))
    version = pick(key, VERSIONS).alias("version")
    return {
        "spark": customer.filter(key % 3 == 0).select(
            key.alias("cluster_id"), version, F.lit("2.12").alias("scala_version"), conf.alias("configuration_params")
        ),
        "kafka": customer.filter(key % 3 == 1).select(key.alias("cluster_id"), version, F.lit("2.13").alias("scala_version")),
        "hadoop": customer.filter(key % 3 == 2).select(key.alias("cluster_id"), version),
    }


PROCESS_NAMES = ["Master", "Worker", "History_Server"]


def processes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", F.lit("stopped")).when(F.col("o_orderstatus") == "O", F.lit("running"))
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("cluster_id"),
        pick(key, PROCESS_NAMES).alias("name"),
        text("10.0.0.", key % 250).alias("host_ip"),
        (key % 1000 + 7000).cast("int").alias("port"),
        status.otherwise(F.lit("starting")).alias("status"),
        key.alias("pid"),
    )


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        text("host-", F.col("c_nationkey")).alias("name"),
        F.col("c_custkey").alias("cluster_id"),
        text("10.0.0.", F.col("c_nationkey")).alias("host_ip"),
        F.lit("running").alias("status"),
        F.timestamp_add("HOUR", -(F.col("c_custkey") % 1000), now()).alias("dt_added"),
    )


def orgs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, folder, "region").select(
        key.alias("id"),
        F.col("r_name").alias("name"),
        F.lower("r_name").alias("slug_id"),
        F.timestamp_add("HOUR", -(key * 240 + 5), now()).alias("dt_created"),
        F.lit(25).alias("validity_days"),
    )


def workspaces(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        key.alias("id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("org_id"),
        F.timestamp_add("DAY", -key, now()).alias("dt_created"),
    )


def plans(spark: SparkSession, folder: str) -> DataFrame:
    """No plan for organisation 4."""
    key = F.col("r_regionkey")
    return table(spark, folder, "region").filter(key != 4).select(
        key.alias("org_id"), (key * 50).alias("max_local"), F.lit(40).alias("max_remote")
    )


def cluster_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for clusters: a quarter ask for a taken name, and ten share one new name."""
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, F.col("c_name")).otherwise(text("new-", F.call_function("div", key, F.lit(10))))
    return table(spark, folder, "customer").select(
        key.alias("request_id"), F.col("c_nationkey").alias("workspace_id"), name.alias("name"),
        pick(key, PROVIDERS).alias("provider"),
    )


def cluster_updates(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderdate").alias("updated_at"),
        key.alias("seq"),
        pick(key, ["running", "terminated", "deleted", "starting"]).alias("status"),
        F.when(key % 3 != 0, text("u", key)).alias("status_detail"),
    )


def process_updates(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("cluster_id"),
        pick(F.call_function("div", key, F.lit(3)), PROCESS_NAMES).alias("name"),
        F.col("o_orderdate").alias("updated_at"),
        key.alias("seq"),
        pick(key, ["running", "stopped"]).alias("status"),
        F.when(key % 4 == 0, key + 1).alias("pid"),
    )


def service_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for a service in a workspace."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("request_id"), (F.col("c_nationkey") + key % 2 * 100).alias("workspace_id"), pick(key, SERVICES).alias("service_name")
    )


def members(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
    )


def member_profiles(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, folder, "supplier")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("s_suppkey").alias("member_id"),
        F.col("n_regionkey").alias("org_id"),
        F.col("s_nationkey").alias("workspace_id"),
        pick(F.col("s_suppkey"), ["dark", "light"]).alias("web_theme"),
        F.lit("light").alias("desktop_theme"),
    )


ROLE_POLICIES = [
    "workspace.manage:workspace.manageClusters", "workspace.read", "org.manage:org.billing", "WORKSPACE.READ:bogus",
]


def roles(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "supplier").select((F.col("s_suppkey") % 4).alias("role_id")).distinct()
    return ids.select("role_id", pick(F.col("role_id"), ROLE_POLICIES).alias("access_policies"))


def member_roles(spark: SparkSession, folder: str) -> DataFrame:
    """A role elsewhere, for every tenth member, must grant nothing."""
    in_org = F.col("member_id") % 4 == 2
    elsewhere = F.when(F.col("member_id") % 10 == 0, 1).otherwise(0)
    return member_profiles(spark, folder).select(
        "member_id",
        (F.col("member_id") % 4).alias("role_id"),
        F.when(in_org, F.lit("org")).otherwise(F.lit("workspace")).alias("subject_type"),
        (F.when(in_org, F.col("org_id")).otherwise(F.col("workspace_id")) + elsewhere).alias("subject_id"),
    )


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("member_id"),
        F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate")).alias("expiry"),
    )


def logins(spark: SparkSession, folder: str) -> DataFrame:
    """One sign-in per member, two for odd ones."""
    kinds = F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 2).cast("int"))).alias("k")
    return table(spark, folder, "supplier").select("s_suppkey", kinds).select(
        (F.col("s_suppkey") * 10 + F.col("k")).alias("id"),
        F.col("s_suppkey").alias("member_id"),
        F.when(F.col("k") == 0, F.lit("credentials")).otherwise(F.lit("github")).alias("provider_id"),
    )


RAW_STATES = ["running", "stopped", "RUNNING", "failed", "bogus", "not running", None]
RAW_MANAGERS = ["spark://h:7077", "yarn", "YARN", "k8s://h", "mesos://h"]


def raw_states(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(pick(F.col("o_orderkey"), RAW_STATES).alias("raw"))


def raw_managers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(pick(F.col("c_custkey"), RAW_MANAGERS).alias("address"))


def cluster_apps(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(F.col("o_orderstatus") == "O", F.lit("running"))
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("cluster_id"), status.otherwise(F.lit("failed")).alias("status")
    )


def cluster_nodes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    pair = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    return table(spark, folder, "supplier").select("s_suppkey", pair).select(
        key.alias("cluster_id"),
        text("n", key, "-", F.col("k")).alias("node_id"),
        text("host-", key % 40).alias("host"),
        (key % 8 + 1).cast("int").alias("cpu_cores"),
        ((F.col("k").cast("bigint") + 1) * 1073741824).alias("memory"),
    )


def packages(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part").select(
        key.alias("id"),
        F.col("p_brand").alias("name"),
        F.when(key % 11 == 0, text(size, ".", key % 10)).otherwise(text(size, ".", key % 10, ".", key % 3)).alias("version"),
        (key % 7 == 0).alias("is_deprecated"),
    )


CONNECTION_KINDS = ["postgres", "mysql", "s3", "cassandra", "unlisted"]
PROVIDER_KINDS = ["postgres", "mysql", "s3", "cassandra", "mariadb"]


def connections(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("id"),
        F.col("s_nationkey").alias("workspace_id"),
        F.col("s_name").alias("name"),
        F.lit(1).alias("schema_version"),
        pick(key, CONNECTION_KINDS).alias("provider"),
        F.timestamp_add("HOUR", -(key % 1000), now()).alias("dt_created"),
    )


def connection_providers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, folder, "region").select(
        pick(key, PROVIDER_KINDS).alias("name"),
        F.col("r_name").alias("description"),
        pick(key, ["rdbms", "rdbms", "fs", "nosql", "rdbms"]).alias("category"),
    )


def sandboxes(spark: SparkSession, folder: str) -> DataFrame:
    """Service options as JSON text; even rows offer two options, odd ones one."""
    key = F.col("p_partkey")
    standalone = text('{"id":"Spark Standalone","services":[{"name":"spark","version":"3.', key % 4, '.0"}]}')
    on_yarn = text(
        '{"id":"Spark on YARN","services":[{"name":"spark","version":"3.2.0"},{"name":"hadoop","version":"3.3.', key % 3, '"}]}'
    )
    both = F.concat(F.lit("["), standalone, F.lit(","), on_yarn, F.lit("]"))
    one = F.concat(F.lit("["), standalone, F.lit("]"))
    return table(spark, folder, "part").select(
        key.alias("id"), text("v", key % 5).alias("version"), F.when(key % 2 == 0, both).otherwise(one).alias("service_options")
    )


def conf_lines(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    line = (
        F.when(key % 33 == 0, F.lit("# note"))
        .when(key % 20 == 0, text("spark.k", size % 10, " ", size, " extra"))
        .otherwise(text("spark.k", size % 10, "  ", size))
    )
    return table(spark, folder, "part").select((key % 50).alias("cluster_id"), line.alias("line"), key.alias("position"))


def conf_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Three default settings of each cluster; two share a key with user settings."""
    ids = table(spark, folder, "part").select((F.col("p_partkey") % 50).alias("cluster_id")).distinct()
    rows = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(value).alias("value")) for key, value in
                     [("spark.k0", "default0"), ("spark.k1", "default1"), ("spark.master", "local")]])
    return ids.select("cluster_id", F.inline(rows))


def statements(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    kinds = ["select 1", "INSERT into t", " update t", "alter table t", "", "drop\ntable t", "  "]
    return table(spark, folder, "part").select(key.alias("id"), pick(key, kinds).alias("statement"))


def job_configs(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    extra = F.array(text("spark.k ", size), F.lit("# note"), F.lit(""), F.lit("three words here"), F.lit("spark.ui.enabled false"))
    return table(spark, folder, "part").select(
        key.alias("id"),
        F.struct(
            text("job-", key).alias("job_name"),
            text("org.app.", F.col("p_type")).alias("class_name"),
            text("/jobs/", key, ".jar").alias("artifact_path"),
            text("--day ", key % 31 + 1, "\n --full").alias("application_params"),
            (size % 4 + 1).alias("driver_memory"),
            (size % 8 + 1).alias("executor_memory"),
            (size % 3 + 1).alias("executor_cores"),
            (size % 5 + 1).alias("num_executors"),
            F.when(key % 2 == 0, extra).otherwise(F.array().cast("array<string>")).alias("extra_conf"),
        ).alias("job"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in the fixed layout; every 97th is malformed."""
    event = F.col("event_type")
    level = F.when(event == "error", F.lit("ERROR")).when(event == "signup", F.lit("WARN ")).otherwise(F.lit("INFO "))
    line = F.concat_ws(
        "||",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS' +0000'"),
        level,
        text("t-", F.col("user_id") % 4),
        F.concat(F.lit("org.app."), event),
        F.col("props"),
    )
    broken = F.col("event_id") % 97 == 0
    return table(spark, folder, "events").select(
        F.col("event_id").alias("log_offset"),
        F.when(broken, text("broken line ", F.col("event_id"))).otherwise(line).alias("line"),
    )


def errors(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")

    def frame(place: int) -> Column:
        return F.struct(
            text("org.app.C", key % 3).alias("class_name"),
            F.lit(f"m{place}").alias("method_name"),
            (F.col("user_id") % 5 + place).cast("int").alias("line_number"),
        )

    return table(spark, folder, "events").filter(F.col("event_type") == "error").select(
        pick(key, ["error", "warn", "fatal", "odd"]).alias("severity"),
        pick(F.col("user_id"), ["code", "runtime", "other"]).alias("source"),
        text("cause-", F.col("user_id") % 7).alias("cause"),
        F.slice(F.array(frame(0), frame(1)), F.lit(1), (key % 3).cast("int")).alias("traces"),
    )


def master_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A status page per supplier, in the older layout for even keys and the newer for odd ones."""
    key = F.col("s_suppkey")
    cores, used = key % 16 + 1, key % 5
    state = F.when(key % 3 == 0, F.lit("STANDBY")).otherwise(F.lit("ALIVE"))
    style = F.when(key % 2 == 0, F.lit("unstyled")).otherwise(F.lit("list-unstyled"))

    def worker(place: int) -> Column:
        return text(
            f"\n<tr>\n<td>\n<a href=\"http://w{place}:8081\">\n worker-", key, f"-{place}\n</a></td>\n<td>10.0.{place}.",
            key % 250, ":6060</td>\n<td>", pick(key + place, ["ALIVE", "DEAD", "ALIVE"]), "</td>\n<td>", cores, " (", used,
            " Used)</td>\n<td sorttable_customkey=\"1\">\n ", cores, ".0 GiB\n (", used, ".0 B Used)\n</td>\n<td></td>\n</tr>",
        )

    html = text(
        "<html><body><h3>Spark Master</h3><ul class=\"", style, "\">\n<li><strong>URL:</strong> spark://h", key,
        ":7077</li>\n<li><strong>Alive Workers:</strong> ", key % 3, "</li>\n<li><strong>Cores in use:</strong> ", cores,
        " Total,\n ", used, " Used</li>\n<li><strong>Memory in use:</strong>\n ", cores, ".0 GiB Total,\n ", used,
        ".0 B Used</li>\n<li><strong>Status:</strong> ", state, "</li>\n</ul>\n",
        "<div class=\"aggregated-workers collapsible-table\"><table><thead><th>Worker Id</th></thead><tbody>",
        worker(0), worker(1), "</tbody></table></div>\n",
        "<span id=\"running-app\" class=\"collapse-aggregated-activeApps collapse-table\"><h4><a>Running Applications (",
        key % 14, ")</a></h4></span>\n",
        "<span id=\"completed-app\" class=\"collapse-aggregated-completedApps collapse-table\"><h4><a>Completed Applications (",
        key % 120, ")</a></h4></span></body></html>",
    )
    return table(spark, folder, "supplier").select(key.alias("page_id"), html.alias("html"))


def yarn_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics and node answers of a YARN cluster per supplier."""
    key = F.col("s_suppkey")
    metrics = F.to_json(
        F.struct(
            F.struct(
                (key % 50).alias("appsCompleted"), (key % 7).alias("appsRunning"),
                (key % 3).alias("appsPending"), (key % 2).alias("appsKilled"),
            ).alias("clusterMetrics")
        )
    )

    def node(place: int) -> Column:
        return F.struct(
            text("node-", key, f":{place}").alias("id"),
            (key % 64 * 100 + place).alias("usedMemoryMB"),
            F.lit(8192).alias("availMemoryMB"),
            (key % 8).alias("usedVirtualCores"),
            F.lit(8 + place).alias("availableVirtualCores"),
        )

    nodes = F.to_json(F.struct(F.struct(F.array(node(0), node(1)).alias("node")).alias("nodes")))
    return table(spark, folder, "supplier").select(key.alias("cluster_id"), metrics.alias("metrics"), nodes.alias("nodes"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """An application per order with one to three attempts, newest first; status P leaves the newest open."""
    key, start = F.col("o_orderkey"), F.col("start")

    def attempt(place: int) -> Column:
        begun = start - place * 7200000
        open_ended = (F.col("o_orderstatus") == "P") if place == 0 else F.lit(False)
        length = (key % 5000) * 1000 + 500
        return F.struct(
            F.lit(str(place + 1)).alias("attempt_id"),
            begun.alias("start_ms"),
            F.when(open_ended, F.lit(-1).cast("bigint")).otherwise(begun + length).alias("end_ms"),
            (~open_ended).alias("completed"),
            F.when(open_ended, F.lit(0).cast("bigint")).otherwise(length).alias("duration_ms"),
            text("u", key % 9).alias("spark_user"),
        )

    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", epoch_ms("o_orderdate").alias("start"))
    attempts = F.slice(F.array(attempt(0), attempt(1), attempt(2)), F.lit(1), (key % 3 + 1).cast("int"))
    return orders.select(key.alias("app_id"), text("app-", key).alias("name"), attempts.alias("attempts"))


def tasks_of(lineitem: DataFrame) -> DataFrame:
    """One row per task. Five applications of two jobs and eight stages; stages and executors count from 0 in each."""
    stage = F.col("l_orderkey") % 40
    duration = rounded(F.col("l_quantity") * 1000)
    line = F.col("l_linenumber").cast("bigint")
    return lineitem.select(
        F.call_function("div", stage, F.lit(8)).alias("app_id"),
        F.call_function("div", stage, F.lit(4)).alias("job_id"),
        (stage % 8).alias("stage_id"),
        (F.col("l_suppkey") % 8).alias("executor_id"),
        epoch_ms("l_shipdate").alias("launch_ms"),
        duration.alias("duration_ms"),
        rounded(F.col("l_tax") * 10000).alias("gc_ms"),
        rounded(F.col("l_extendedprice") * 100).alias("input_bytes"),
        line.alias("input_records"),
        (F.col("l_partkey") * 10).alias("output_bytes"),
        line.alias("output_records"),
        (F.col("l_partkey") * 3).alias("shuffle_read_bytes"),
        line.alias("shuffle_read_records"),
        (F.col("l_suppkey") * 3).alias("shuffle_write_bytes"),
        line.alias("shuffle_write_records"),
        line.alias("scheduler_delay"),
        duration.alias("compute"),
        (F.col("l_partkey") % 100).alias("shuffle_read_time"),
        (F.col("l_suppkey") % 100).alias("shuffle_write_time"),
        (F.col("l_orderkey") % 7).alias("getting_result"),
        (F.col("l_orderkey") % 5).alias("deserialise"),
        (F.col("l_orderkey") % 3).alias("serialise"),
        F.when(F.col("l_returnflag") == "R", F.lit("failed"))
        .when(F.col("l_returnflag") == "A", F.lit("completed"))
        .otherwise(F.lit("active"))
        .alias("state"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    return tasks_of(table(spark, folder, "lineitem"))


def executors(spark: SparkSession, folder: str) -> DataFrame:
    """Some executors of six applications; tasks know others, and none of the last application."""
    supplier = F.col("s_suppkey")
    ids = table(spark, folder, "supplier").select((supplier % 6).alias("app_id"), (supplier % 9).alias("executor_id"))
    return ids.distinct().select(
        "app_id",
        "executor_id",
        (F.col("executor_id") % 4 + 1).alias("cores"),
        ((F.col("executor_id") + 1) * 1000000).alias("max_memory"),
        ((F.col("executor_id") + 1) * 123456).alias("used_memory"),
        (F.col("executor_id") * 777).alias("disk_used"),
    )


REGION_OF_EVENT = {"click": "eden", "view": "old", "purchase": "survivor", "signup": "metaspace", "error": "code_cache"}


def samples_of(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    regions = F.create_map(*[F.lit(part) for pair in REGION_OF_EVENT.items() for part in pair])
    cpu = rounded(F.col("value")) % 100
    return events.select(
        (user % 6).alias("app_id"),
        (user % 8 % 3).alias("worker_id"),
        (user % 8).alias("executor_id"),
        "ts",
        rounded(F.col("value") * 100).alias("used"),
        F.lit(60000).cast("bigint").alias("max_memory"),
        F.try_element_at(regions, F.col("event_type")).alias("region"),
        (user % 8 + 1).alias("cores"),
        (user % 5).alias("tasks"),
        F.when(user % 2 == 0, cpu).alias("executor_cpu"),
        F.when(user % 2 == 1, cpu).alias("system_cpu"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return samples_of(table(spark, folder, "events"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per application, and region names for run names."""
    key = F.col("r_regionkey").cast("bigint")
    return table(spark, folder, "region").select(
        key.alias("run_id"), F.col("r_name").alias("name"), pick(key, ["succeeded", "failed", "odd"]).alias("status")
    )


def deployment_runs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    ended = F.timestamp_add("SECOND", (key % 200000) + 1, F.col("o_orderdate"))
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("deployment_id"),
        key.alias("run_id"),
        pick(key, ["succeeded", "failed", "running", "odd"]).alias("status"),
        pick(key, ["manually", "by agent", "timer"]).alias("trigger"),
        F.col("o_orderdate").alias("started"),
        F.when(F.col("o_orderstatus") != "P", ended).alias("ended"),
    )


ALERT_METRICS = ["appFinalStatus", "appRuntime", "totalExecutorRuntime", "totalJVMGCtime", "maxTaskRuntime"]


def alert_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule per nation on one of the jobs."""
    key = F.col("n_nationkey")
    metric = pick(key, ALERT_METRICS)
    return table(spark, folder, "nation").select(
        key.cast("bigint").alias("alert_id"),
        (key % 10).cast("bigint").alias("job_id"),
        metric.alias("metric"),
        F.when(metric == "appFinalStatus", F.lit("equals")).otherwise(F.lit("exceeds")).alias("operator"),
        F.when(metric == "appFinalStatus", F.lit(0)).otherwise(key * 7).alias("value"),
        F.when(metric == "appFinalStatus", F.lit("boolean"))
        .otherwise(pick(key, ["ms", "secs", "mins", "hrs"]))
        .alias("unit"),
    )


STATUS_OF_EVENT = {
    "view": "running", "click": "starting", "purchase": "new", "signup": "terminating", "error": "terminated",
}


def status_of(events: DataFrame) -> DataFrame:
    states = F.create_map(*[F.lit(part) for pair in STATUS_OF_EVENT.items() for part in pair])
    return events.select(
        F.col("user_id").alias("cluster_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.try_element_at(states, F.col("event_type")).alias("status"),
    )


def progress_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("cluster_id"),
        "ts",
        F.col("event_id").alias("seq"),
        text(rounded(F.col("value") * 100), "/60000").alias("status_detail"),
    )


def process_changes_of(events: DataFrame) -> DataFrame:
    """Changes of three processes per cluster; half of the statuses stop them."""
    event = F.col("event_type")
    status = F.when(event == "view", F.lit("running")).when(event == "click", F.lit("running")).otherwise(F.lit("stopped"))
    return events.select(
        F.col("user_id").alias("cluster_id"),
        pick(F.col("event_id"), PROCESS_NAMES).alias("name"),
        "ts",
        F.col("event_id").alias("seq"),
        status.alias("status"),
    )


def checks_of(events: DataFrame) -> DataFrame:
    """Process checks; errors and sign-ups found the process down."""
    return events.select(
        F.col("user_id").alias("cluster_id"),
        pick(F.col("event_id"), PROCESS_NAMES).alias("process"),
        "ts",
        F.col("event_id").alias("seq"),
        (~F.col("event_type").isin("error", "signup")).alias("alive"),
    )
