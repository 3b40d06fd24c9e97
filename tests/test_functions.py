"""Text and number formats at their boundaries."""

import pytest
from pyspark.sql import functions as F

from gridsight.functions import names, numbers, parsing, sizes, times

SECOND, MINUTE, HOUR, DAY, MONTH, YEAR = 1000, 60000, 3600000, 86400000, 2592000000, 31536000000


def check(spark, function, cases, type_="bigint"):
    df = spark.createDataFrame([(value,) for value, _ in cases], f"v {type_}")
    got = [row[0] for row in df.select(function(F.col("v"))).collect()]
    assert got == [expected for _, expected in cases]


def test_format_interval(spark):
    check(spark, times.format_interval, [
        (0, "0 secs"), (59, "59 secs"), (60, "1 mins"), (3599, "59 mins"), (3600, "1 hrs"), (86399, "23 hrs"),
        (86400, "1 days"), (2591999, "29 days"), (2592000, "1 mon"), (31535999, "12 mon"), (31536000, "1 yrs"),
        (63072001, "2 yrs"), (-5, "-5 secs"),
    ])


def test_format_interval_ms(spark):
    check(spark, times.format_interval_ms, [
        (999, "999 ms"), (1000, "1 s"), (1499, "1 s"), (1500, "2 s"), (59999, "60 s"), (MINUTE, "1 m"),
        (90000, "1 m"), (90001, "2 m"), (150000, "2 m"), (HOUR, "1.0 h"), (HOUR * 5 // 4, "1.2 h"), (HOUR * 5 // 4 + 1, "1.3 h"),
        (DAY - 1, "24.0 h"), (DAY, "1 d"), (DAY * 3 // 2, "1 d"), (DAY * 3 // 2 + 1, "2 d"), (MONTH, "1 mo"),
        (2 * MONTH - 1, "1 mo"), (YEAR - 1, "12 mo"), (YEAR, "1 y"), (2 * YEAR - 1, "1 y"), (-3, "-3 ms"),
    ])


def test_format_interval_ms_decimal(spark):
    check(spark, times.format_interval_ms_decimal, [
        (999, "999 ms"), (1050, "1.1 s"), (1049, "1.0 s"), (MINUTE, "1.0 m"), (63000, "1.0 m"), (63001, "1.1 m"),
        (81000, "1.3 m"), (HOUR, "1.0 h"), (HOUR * 5 // 4, "1.2 h"), (DAY, "1 d"), (YEAR, "1 y"),
    ])


def test_format_interval_ms_days(spark):
    check(spark, times.format_interval_ms_days, [
        (999, "999 ms"), (63000, "1.1 m"), (HOUR * 5 // 4, "1.3 h"), (DAY, "1.0 d"), (DAY * 5 // 4, "1.3 d"), (400 * DAY, "400.0 d"),
    ])


def test_readable_time(spark):
    check(spark, times.readable_time, [
        (1000, "1000 ms"), (1001, "1 secs"), (1050, "1.1 secs"), (MINUTE, "60 secs"), (MINUTE + 1, "1 mins"), (90000, "1.5 mins"),
        (HOUR, "60 mins"), (HOUR + 1, "1 hrs"), (DAY, "24 hrs"), (DAY + 1, "1 days"), (DAY * 5 // 2, "2.5 days"), (0, "0 ms"),
    ])
    check(spark, times.time_unit, [(1, "sec"), (MINUTE, "sec"), (MINUTE + 1, "mins"), (HOUR + 1, "hrs"), (DAY + 1, "day")])
    check(spark, lambda v: times.ms_in_unit(v, F.lit("mins")), [(90000, 1.5), (MINUTE, 1.0)])


def test_split_ms(spark):
    check(spark, times.split_ms, [(90061001, (1, 1, 1, 1, 1)), (-90061001, (-1, -1, -1, -1, -1)), (999, (0, 0, 0, 0, 999))])


def test_elapsed_and_message_time(spark):
    at = times.moment
    row = spark.range(1).select(
        times.time_elapsed(at("2024-01-01 00:00:00"), F.lit(None).cast("timestamp_ntz"), at("2024-01-01 01:15:00")),
        times.time_elapsed_fraction(at("2024-01-01 00:00:00"), at("2024-01-01 00:00:01.050")),
        times.message_time(F.lit(1704067200123).cast("bigint")),
        times.epoch_ms(at("2024-01-01 00:00:00.123456")),
    ).first()
    assert tuple(row) == ("1.2 h", "1.1 s", "01-01-2024 00:00:00.123", 1704067200123)


def test_readable_size(spark):
    check(spark, sizes.readable_size, [
        (0, "0 B"), (1023, "1023 B"), (-1023, "-1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (-1536, "-1.5 KB"),
        (1048523, "1023.9 KB"), (1048524, "1023.9 KB"), (1048525, "1.0 MB"), (1048576, "1.0 MB"), (1 << 30, "1.0 GB"), (1 << 40, "1.0 TB"), (1 << 50, "1.0 PB"),
        (1 << 60, "1.0 EB"), (2**63 - 1, "8.0 EB"), (-(2**63), "-8.0 EB"),
    ])


def test_display_sizes(spark):
    check(spark, sizes.bytes_to_size, [
        (0, "0 B"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1048575, "1024.0 KB"),
        (1048576, "1.0 MB"), (1 << 40, "1.0 TB"), (1 << 50, "1024.0 TB"), (2**63 - 1, "8388608.0 TB"),
    ])
    check(spark, sizes.bytes_to_decimal_size, [
        (0, "0 B"), (1000, "1000 Bytes"), (1024, "1.0 KB"), (1500, "1.5 KB"), (1048576, "1.0 MB"), (134217728, "134.2 MB"),
    ])


def test_percentages(spark):
    df = spark.createDataFrame([(1, 3), (1, 8), (5, 0), (0, 4), (200, 100)], "a bigint, b bigint")
    assert [row[0] for row in df.select(numbers.percent(F.col("a"), F.col("b"))).collect()] == [33, 13, None, 0, 200]
    check(spark, numbers.fraction_percent, [(0.256, "26%"), (1.0, "100%"), (0.0, "0%")], "double")


@pytest.mark.parametrize("value, expected", [
    ("12/60000", (12, 60000)), ("x/2", (None, 2)), ("7", (7, None)), ("", (None, None)),
])
def test_parse_progress(spark, value, expected):
    check(spark, parsing.parse_progress, [(value, expected)], "string")


def test_parsers(spark):
    check(spark, parsing.parse_conf_line, [
        ("a b", ("a", "b")), ("  a   b ", ("a", "b")), ("a", None), ("a b c", None), ("# note", None), ("", None), ("#a b", None),
    ], "string")
    check(spark, parsing.parse_version, [
        ("3.2.1", (3, 2, 1)), ("3.2", (3, 2, None)), ("4.0.0-rc1", (4, 0, None)), ("", (None, None, None)),
    ], "string")
    check(spark, parsing.parse_host_port, [("h:9042", ("h", 9042)), ("h", ("h", None))], "string")


def test_submit_command(spark):
    job = spark.sql(
        "SELECT named_struct('job_name', 'j', 'class_name', 'a.B', 'artifact_path', '/x.jar', 'application_params', 'p1\np2', "
        "'driver_memory', 1, 'executor_memory', 2, 'executor_cores', 3, 'num_executors', 4, 'extra_conf', "
        "array('k v', '', '# c', 'a b c')) AS job"
    )
    assert job.select(parsing.submit_command("job")).first()[0] == (
        "spark-submit --name j --class a.B --executor-memory 2g --driver-memory 1g --executor-cores 3 --num-executors 4 "
        "--conf k=v /x.jar p1p2"
    ).split(" ")


def test_names(spark):
    check(spark, lambda v: names.normalise(v, "cluster_status"), [("running", "running"), ("Running", "unknown"), (None, "unknown")], "string")
    check(spark, lambda v: names.normalise(v, "severity"), [("fatal", "fatal"), ("x", "info")], "string")
    check(spark, names.provider_of, [
        ("spark://a", "spark-standalone"), ("YARN", "yarn"), ("k8s://b", "k8s"), ("mesos", None), ("yarn-client", None),
    ], "string")


def test_rounding(spark):
    check(spark, lambda v: numbers.half_up(v, 10), [(4, 0), (5, 1), (14, 1), (15, 2)])
    check(spark, lambda v: numbers.half_down(v, 10), [(5, 0), (6, 1), (15, 1), (16, 2)])
    check(spark, numbers.tenths_text, [(5, "0.5"), (10, "1.0"), (123, "12.3")])
