import json
import os

import pytest
from pyspark.sql import functions as F

from gridsight.operators import apps, files as listing, logs, query
from gridsight.sources import connections, databases, files, topics


@pytest.fixture(scope="module")
def derby(spark):
    return connections.derby_memory("local", "sources")


def test_jdbc_round_trip(spark, derby, rows):
    data = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("kind"))
    assert databases.write_jdbc(data, derby, "numbers", "overwrite") == 100
    assert databases.write_jdbc(data.filter("id < 5"), derby, "numbers") == 5
    assert databases.read_jdbc(spark, derby, table="numbers").count() == 105
    grouped = databases.read_jdbc(spark, derby, query='SELECT "kind", count(*) AS n FROM numbers GROUP BY "kind"')
    assert rows(grouped.select(F.col("kind"), F.col("N"))) == [(0, 36), (1, 35), (2, 34)]


def test_jdbc_read_in_parts_pushes_filters(spark, derby):
    databases.write_jdbc(spark.range(100).select(F.col("id").alias("N")), derby, "parts", "overwrite")
    split = databases.Partitioning("N", 0, 100, 4)
    table = databases.read_jdbc(spark, derby, table="parts", partition=split)
    assert table.rdd.getNumPartitions() == 4 and table.count() == 100
    part = databases.read_jdbc(spark, derby, query="SELECT N FROM parts WHERE N >= 50", partition=split)
    assert part.count() == 50
    plan = table.filter("N > 90")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(N,90)" in plan


def test_jdbc_range_is_looked_up(spark, derby):
    data = spark.sql("SELECT id AS N, date_add(date'2024-01-01', int(id)) AS D FROM range(100) UNION ALL SELECT NULL, NULL")
    databases.write_jdbc(data, derby, "ranged", "overwrite")
    for column in ("N", "D"):
        table = databases.read_jdbc(spark, derby, table="ranged", partition=databases.Partitioning(column, partitions=4))
        sizes = table.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert len(sizes) == 4 and sum(sizes) == 101 and max(sizes) < 40
        assert table.select("N").distinct().count() == 101
    part = databases.read_jdbc(spark, derby, query="SELECT N FROM ranged WHERE N >= 50", partition=databases.Partitioning("N", partitions=5))
    assert part.count() == 50 and part.rdd.getNumPartitions() == 5
    empty = databases.read_jdbc(spark, derby, query="SELECT N FROM ranged WHERE N > 1000", partition=databases.Partitioning("N"))
    assert empty.count() == 0


def test_only_queries_are_read(spark, derby):
    with pytest.raises(ValueError):
        databases.read_jdbc(spark, derby, query="DROP TABLE numbers")
    with pytest.raises(ValueError):
        databases.read_jdbc(spark, derby)


def test_catalog(spark, derby, rows):
    databases.write_jdbc(spark.range(1), derby, "catalogued", "overwrite")
    catalog = databases.read_jdbc(
        spark, derby,
        query="SELECT s.SCHEMANAME AS schema_name, t.TABLENAME AS table_name, t.TABLETYPE AS kind FROM SYS.SYSTABLES t "
        "JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID",
    ).toDF("table_schema", "table_name", "kind")
    typed = catalog.select(
        "table_schema", "table_name", F.lit("local").alias("table_catalog"),
        F.when(F.col("kind") == "T", "TABLE").otherwise("SYSTEM TABLE").alias("table_type"),
    )
    assert ("CATALOGUED",) in rows(query.catalog_tables(typed, "APP"))
    assert rows(query.catalog_tables(typed, "SYS")) == []
    assert ("CATALOGUED",) in rows(query.catalog_tables(typed, "local", namespace_column="table_catalog"))
    assert ("APP",) in rows(query.catalog_schemas(typed)) and rows(query.catalog_catalogs(typed)) == [("local",)]


def test_connection_options():
    assert connections.postgres("n", "h", "d").url == "jdbc:postgresql://h:5432/d"
    assert connections.mysql("n", "h", "d").url == "jdbc:mysql://h:3306/d"
    assert connections.mariadb("n", "h", "d", port=3307).url == "jdbc:mariadb://h:3307/d"
    roach = connections.cockroachdb("n", "h", "d", "c1", "u", "p")
    assert roach.url == "jdbc:postgresql://h:26257/d?options=--cluster%3Dc1"
    assert roach.options()["user"] == "u" and "user" not in connections.postgres("n", "h", "d").options()
    assert "hidden" not in repr(connections.postgres("n", "h", "d", "u", "hidden"))
    wide = connections.CassandraConnection("n", "dc1", ("a:9042", "b:9042"), "u", "p").options("k", "t")
    assert wide["spark.cassandra.connection.host"] == "a:9042,b:9042" and wide["spark.cassandra.connection.localDC"] == "dc1"
    assert "spark.cassandra.auth.username" not in connections.CassandraConnection("n", "dc", ("a:1",), " ").options("k", "t")
    store = connections.ObjectStoreConnection("n", "b", "eu-1", "ak", "sk")
    assert store.path("x/") == "s3a://b/x/" and store.hadoop_options()["fs.s3a.bucket.b.endpoint.region"] == "eu-1"
    assert topics.topic_options("h:9092", ["a", "b"])["subscribe"] == "a,b"


def test_file_listing_does_not_read_content(spark, tmp_path, rows):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("12345")
    (tmp_path / "y.csv").write_text("1")
    entries = files.read_file_listing(spark, str(tmp_path))
    assert rows(entries, "name", "is_directory", "size") == [("a/", True, 0), ("a/x.txt", False, 5), ("y.csv", False, 1)]
    assert rows(files.read_file_listing(spark, str(tmp_path), glob="*.csv"), "name") == [("a/",), ("y.csv",)]
    assert rows(files.read_file_listing(spark, str(tmp_path), recursive=False), "name") == [("a/",), ("y.csv",)]
    assert all(row["last_modified"] > 1_500_000_000 for row in entries.collect())
    assert rows(listing.list_root(entries), "name") == [("a/",), ("y.csv",)]


@pytest.mark.parametrize("prefixes", [1, 2, 4, 1000])
def test_folders_are_listed_however_many_are_handed_out(spark, tmp_path, rows, prefixes):
    expected = []
    for one in range(3):
        for two in range(2):
            folder = tmp_path / f"d{one}" / f"e{two}"
            folder.mkdir(parents=True)
            (folder / "empty").mkdir()
            (folder / "f.bin").write_text("x" * one)
            expected += [(f"d{one}/e{two}/", True, 0), (f"d{one}/e{two}/empty/", True, 0), (f"d{one}/e{two}/f.bin", False, one)]
        expected.append((f"d{one}/", True, 0))
    (tmp_path / "bare").mkdir()
    entries = files.read_file_listing(spark, str(tmp_path), prefixes=prefixes)
    assert rows(entries, "name", "is_directory", "size") == sorted([*expected, ("bare/", True, 0)], key=repr)
    assert rows(listing.list_root(entries), "name") == [("bare/",), ("d0/",), ("d1/",), ("d2/",)]
    assert rows(listing.list_prefix(entries, "d1/e0/"), "name", "is_directory") == [("d1/e0/", True), ("d1/e0/empty/", True), ("d1/e0/f.bin", False)]
    assert rows(listing.with_file_kind(entries).filter("extension = 'bin'"), "size_text") == [("0 B",)] * 2 + [("1 Bytes",)] * 2 + [("2 Bytes",)] * 2


def test_an_empty_folder_has_no_entries(spark, tmp_path):
    assert files.read_file_listing(spark, str(tmp_path)).collect() == []


def test_hdfs_status(spark, rows):
    entry = {"accessTime": 1, "blockSize": 128, "group": "g", "length": 1500, "modificationTime": 2, "owner": "o",
             "pathSuffix": "f", "permission": "644", "replication": 3, "type": "FILE"}
    folder = dict(entry, pathSuffix="d", type="DIRECTORY", length=0)
    answers = spark.createDataFrame(
        [("/x", json.dumps({"FileStatuses": {"FileStatus": [entry, folder]}})), ("/y", json.dumps({"FileStatus": entry}))],
        "directory string, json string",
    )
    assert rows(listing.hdfs_entries(files.decode_hdfs_status(answers)), "directory", "name", "type", "size_text", "block_size") == [
        ("/x", "d", "DIRECTORY", "--", "128 Bytes"), ("/x", "f", "FILE", "1.5 KB", "128 Bytes"), ("/y", "f", "FILE", "1.5 KB", "128 Bytes"),
    ]


def test_yarn(spark, rows):
    node = {"id": "n1", "usedMemoryMB": 10, "availMemoryMB": 20, "usedVirtualCores": 1, "availableVirtualCores": 3}
    answers = spark.createDataFrame([(1, json.dumps({"nodes": {"node": [node, dict(node, id="n2")]}}))], "cluster_id int, json string")
    overview = apps.yarn_overview(files.decode_yarn_nodes(answers))
    assert rows(overview) == [(1, "n1", False, 10, 20, 1, 3), (1, "n2", False, 10, 20, 1, 3), (1, None, True, 20, 40, 2, 6)]
    metrics = spark.createDataFrame(
        [(1, '{"clusterMetrics":{"appsCompleted":1,"appsRunning":2,"appsPending":3,"appsKilled":4}}')], "cluster_id int, json string"
    )
    assert rows(apps.yarn_applications(files.decode_yarn_metrics(metrics))) == [(1, 1, 2, 3, 4)]


def test_app_history(spark, tmp_path, rows):
    attempt = {"startTimeEpoch": 1000, "endTimeEpoch": 3500, "completed": True, "duration": 2500, "sparkUser": "u", "extra": 1}
    (tmp_path / "apps.json").write_text(json.dumps([{"id": "app-1", "name": "n", "attempts": [attempt]}]))
    history = files.read_app_history(spark, str(tmp_path))
    assert rows(apps.app_status(history)) == [("app-1", "succeeded")]
    assert rows(apps.app_runtime(history, F.lit(0).cast("bigint")), "runtime") == [("2.5 secs",)]


def test_pages_and_lines(spark, tmp_path, rows):
    for name in ("one", "two"):
        (tmp_path / f"{name}.html").write_text("<ul>\n<li>x</li>\n</ul>")
    pages = files.read_html_pages(spark, str(tmp_path))
    assert pages.count() == 2 and all("\n" in row["html"] for row in pages.collect())
    assert files.read_log_lines(spark, str(tmp_path)).select("log_offset.file", "line").count() == 6


def test_names_are_relative_whatever_the_path_looks_like(spark, tmp_path, rows):
    base = tmp_path / "a"
    deep = base / "x" / str(base).lstrip("/")
    deep.mkdir(parents=True)
    (deep / "deep.txt").write_text("1")
    (base / "top.txt").write_text("12")
    expected = [("top.txt", 2), (f"x{base}/deep.txt", 1)]
    for path in (str(base), f"{base}/", f"file:{base}", f"file://{base}"):
        assert rows(files.read_file_listing(spark, path).filter("NOT is_directory"), "name", "size") == expected


def test_log_files_can_be_searched(spark, tmp_path, rows):
    line = "2024-03-0{day} 10:00:00.000 +0000||{level}||{thread}||org.app.Main||{message}"
    for day in (1, 2):
        (tmp_path / f"{day}.log").write_text("\n".join([
            line.format(day=day, level="INFO", thread="spark-master", message=f"begin {day}"),
            "no log line",
            line.format(day=day, level="ERROR", thread="spark-master", message="Bound MasterWebUI to 0.0.0.0"),
            line.format(day=day, level="INFO", thread="spark-master", message="Bound MasterWebUI again"),
        ]))
    lines = files.read_log_lines(spark, str(tmp_path))
    parsed = logs.parse_log_lines(lines)
    assert parsed.count() == 6 and parsed.select("log_offset").distinct().count() == 6
    page = logs.search_logs(parsed, n=4).collect()
    assert [row["message"][:7] for row in page] == ["begin 1", "Bound M", "Bound M", "begin 2"]
    last = page[3]["log_offset"]
    after = F.struct(F.lit(last["file"]).alias("file"), F.lit(last["position"]).alias("position"))
    rest = logs.search_log_lines(lines, last_offset=after, n=4).collect()
    assert [row["message"] for row in rest] == ["Bound MasterWebUI to 0.0.0.0", "Bound MasterWebUI again"]
    assert rows(logs.log_facets(parsed).filter("facet = 'level'"), "value", "lines") == [("ERROR", 2), ("INFO", 4)]
    first = logs.startup_milestones(parsed).first()
    assert first["milestone"] == "spark-master" and first["message"] == "Bound MasterWebUI to 0.0.0.0" and first["ts"].day == 1


def written_lines(path, count):
    """A file of lines of many lengths, and where each begins."""
    lines = [(f"line {number} " + "é" * (number * 37 % 90) + ("\r" if number % 5 == 0 else "")) for number in range(count)]
    path.write_bytes("\n".join(lines).encode())
    places, at = [], 0
    for line in lines:
        places.append((at, line.removesuffix("\r")))
        at += len(line.encode()) + 1
    return places


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_offsets_are_bytes_whatever_the_split(spark, tmp_path, rows, split):
    expected = sorted(written_lines(tmp_path / "one.log", 200) + written_lines(tmp_path / "two.log", 77))
    (tmp_path / "empty.log").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = files.read_log_lines(spark, str(tmp_path)).select("log_offset.position", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, found)) == expected


def test_pages_go_on_in_a_file_that_has_grown(spark, tmp_path):
    line = "2024-03-01 10:00:00.000 +0000||INFO||t||c||message {n}\n"
    path = tmp_path / "app.log"
    path.write_text("".join(line.format(n=n) for n in range(10)))
    page = logs.search_log_lines(files.read_log_lines(spark, str(tmp_path)), n=6).collect()
    with path.open("a") as file:
        file.write("".join(line.format(n=n) for n in range(10, 13)))
    last = page[-1]["log_offset"]
    after = F.struct(F.lit(last["file"]).alias("file"), F.lit(last["position"]).alias("position"))
    rest = logs.search_log_lines(files.read_log_lines(spark, str(tmp_path)), last_offset=after, n=100).collect()
    assert [row["message"] for row in [*page, *rest]] == [f"message {n}" for n in range(13)]


def test_json_rows(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert rows(query.to_json_rows(df)) == [('{"n":1,"s":"a"}',), ('{"n":2}',)]
    target = os.path.join(tmp_path, "out")
    files.write_json_rows(df, target)
    assert spark.read.schema("n int, s string").json(target).count() == 2


def test_topic_records_take_the_shape_of_the_log(spark, rows):
    records = spark.sql(
        "SELECT CAST('k' AS BINARY) AS key, CAST('value' AS BINARY) AS value, 't' AS topic, 1 AS partition, 7L AS offset, "
        "timestamp'2024-01-01 00:00:00.5' AS timestamp UNION ALL SELECT NULL, NULL, 't', 1, 8L, timestamp'2024-01-01 00:00:01'"
    )
    assert rows(topics.shape_records(records)) == [
        ("t", 1, 7, 1704067200500, "k", "value", 6), ("t", 1, 8, 1704067201000, None, None, 0),
    ]


def test_a_folder_of_files_is_a_stream(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = topics.stream_files(spark, spark.range(1).schema, str(tmp_path / "in"), files_per_trigger=1)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
