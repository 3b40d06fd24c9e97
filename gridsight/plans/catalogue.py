"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .binding_sql import with_bindings

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Named:
    """A query, the inventory row it answers, and its check in SQL if there is one."""

    build: Build
    covers: str
    check: str | None


CATALOGUE: dict[str, Named] = {}


def query(covers: str, check: str | None = None, uses: Sequence[str] = ()) -> Callable[[Build], Build]:
    """Registers a function under its own name."""

    def register(build: Build) -> Build:
        name = build.__name__
        if name in CATALOGUE:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(configure(spark), folder)

        CATALOGUE[name] = Named(run, covers, None if check is None else with_bindings(uses, check))
        return build

    return register


def listed(values: Column, separator: str = ",") -> Column:
    """An array as text, so that both engines can be compared on it."""
    return F.array_join(F.transform(values, lambda value: value.cast("string")), separator)
