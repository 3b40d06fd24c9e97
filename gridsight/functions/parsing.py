"""Small text formats taken apart and put together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_progress(text: Column) -> Column:
    """``done/total`` as a struct of longs, null where a part is no number."""
    return F.struct(
        F.split_part(text, F.lit("/"), F.lit(1)).try_cast("bigint").alias("done"),
        F.split_part(text, F.lit("/"), F.lit(2)).try_cast("bigint").alias("total"),
    )


def parse_host_port(text: Column) -> Column:
    """``host:port`` as a struct."""
    return F.struct(
        F.split_part(text, F.lit(":"), F.lit(1)).alias("host"),
        F.split_part(text, F.lit(":"), F.lit(2)).try_cast("int").alias("port"),
    )


def words(text: Column) -> Column:
    """Words between spaces."""
    return F.filter(F.split(F.trim(text), " "), lambda word: word != "")


def parse_conf_line(text: Column) -> Column:
    """``key value`` as a struct; null for blanks, comments and any other word count."""
    parts = words(text)
    usable = (F.size(parts) == 2) & ~F.startswith(F.trim(text), F.lit("#"))
    return F.when(usable, F.struct(parts[0].alias("key"), parts[1].alias("value")))


def parse_version(text: Column) -> Column:
    """``major.minor.patch`` as a struct of integers, null where a part is missing."""
    parts = F.split(text, r"\.")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("int").alias("major"),
        F.get(parts, F.lit(1)).try_cast("int").alias("minor"),
        F.get(parts, F.lit(2)).try_cast("int").alias("patch"),
    )


def submit_command(job: str) -> Column:
    """Arguments that submit the job held in struct column ``job``.

    Configuration lines that are empty, comments or not exactly two words are
    left out. Empty arguments are dropped.
    """
    field = F.col
    conf = F.transform(
        F.filter(
            field(f"{job}.extra_conf"),
            lambda line: (line != "") & ~F.startswith(line, F.lit("#")) & (F.size(F.split(line, " ")) == 2),
        ),
        lambda line: F.concat(F.lit("--conf "), F.split(line, " ")[0], F.lit("="), F.split(line, " ")[1]),
    )
    line = F.concat_ws(
        " ",
        F.lit("spark-submit --name"),
        field(f"{job}.job_name"),
        F.lit("--class"),
        field(f"{job}.class_name"),
        F.lit("--executor-memory"),
        F.concat(field(f"{job}.executor_memory").cast("string"), F.lit("g")),
        F.lit("--driver-memory"),
        F.concat(field(f"{job}.driver_memory").cast("string"), F.lit("g")),
        F.lit("--executor-cores"),
        field(f"{job}.executor_cores").cast("string"),
        F.lit("--num-executors"),
        field(f"{job}.num_executors").cast("string"),
        conf,
        field(f"{job}.artifact_path"),
        F.replace(field(f"{job}.application_params"), F.lit("\n"), F.lit("")),
    )
    return F.filter(F.split(line, " "), lambda word: word != "")
