"""User SQL over registered tables, statement kinds, catalogs and package versions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import parse_version
from .counting import with_copies

# The first words that make a statement an update.
UPDATE_WORDS = ["create", "insert", "update", "delete", "drop"]


def kind_of(statement: Column, any_space: bool = False) -> Column:
    """``update``, ``query`` or, for a blank statement, ``invalid``.

    The first word ends at a space. With ``any_space`` it ends at any white
    space, so a verb followed by a line break counts too.
    """
    text = F.regexp_replace(F.lower(statement), r"^\s+|\s+$", "")
    first = F.split(text, r"\s+" if any_space else " ")[0]
    return (
        F.when(statement.isNull() | (text == ""), F.lit("invalid"))
        .when(first.isin(UPDATE_WORDS), F.lit("update"))
        .otherwise(F.lit("query"))
    )


def statement_kind(statements: DataFrame, column: str, any_space: bool = False) -> DataFrame:
    """Q2: every statement with its kind."""
    return statements.withColumn("kind", kind_of(F.col(column), any_space))


def statement_counts(statements: DataFrame, column: str, any_space: bool = False) -> DataFrame:
    """Q2: statements of each kind."""
    return statement_kind(statements, column, any_space).groupBy("kind").agg(F.count(F.lit(1)).alias("statements"))


def run_query(
    spark: SparkSession, tables: Mapping[str, DataFrame], sql: str, args: Mapping[str, object] | None = None
) -> DataFrame:
    """Q1: the rows of a user's query over the given tables.

    Statements of another kind are refused, and so are results with two columns
    of one name. The tables are handed to the statement itself: they hide tables
    and views of the same name inside it, and the session's views stay as they
    are.
    """
    words = sql.lower().strip().split(" ")
    if words == [""]:
        raise ValueError("empty statement")
    if words[0] in UPDATE_WORDS:
        raise ValueError(f"{words[0]!r} statements are not queries")
    given = {f"table_{place}": table for place, table in enumerate(tables.values())}
    if given:
        names = ", ".join(f"`{name.replace('`', '``')}` AS (SELECT * FROM {{table_{place}}})" for place, name in enumerate(tables))
        body = sql.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
        sql = f"WITH {names} SELECT * FROM (\n{body}\n)"
    result = spark.sql(sql, args=dict(args) if args else None, **given)
    names = [name.lower() for name in result.columns]
    if len(set(names)) != len(names):
        raise ValueError("two result columns have the same name")
    return result


def catalog_tables(
    catalog: DataFrame, namespace: str, namespace_column: str = "table_schema", table_type: str = "TABLE"
) -> DataFrame:
    """Plain tables of a schema, or of a catalog when ``namespace_column`` says so."""
    return catalog.filter((F.col(namespace_column) == namespace) & (F.col("table_type") == table_type)).select("table_name")


def catalog_schemas(catalog: DataFrame) -> DataFrame:
    """Schema names."""
    return catalog.select("table_schema").distinct()


def catalog_catalogs(catalog: DataFrame) -> DataFrame:
    """Catalog names."""
    return catalog.select("table_catalog").distinct()


def parsed_versions(packages: DataFrame) -> DataFrame:
    """Packages with their version in numbers."""
    return packages.withColumn("parsed", parse_version(F.col("version"))).select(
        "id", "name", "version", "parsed.major", "parsed.minor", "parsed.patch"
    )


def package_versions(packages: DataFrame) -> DataFrame:
    """C4: versions of each package that are not deprecated, a row each."""
    return with_copies(packages.filter(~F.col("is_deprecated")), ["name", "version"])


def to_json_rows(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object; missing values are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(name) for name in rows.columns])).alias("json"))
