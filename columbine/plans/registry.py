"""Registry of named queries: a Spark builder and, where SQL can say it, a
DuckDB oracle over the same derived inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from columbine.sources import fixtures as fx


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None
    needs: tuple[str, ...] = field(default_factory=tuple)
    doc: str = ""


QUERIES: dict[str, QuerySpec] = {}


def register(name: str, needs=(), oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``.

    ``oracle`` is the SQL body; the fixtures in ``needs`` are prepended as
    ``WITH`` views so DuckDB sees the same derived inputs as Spark.
    """

    def deco(fn):
        sql = fx.duckdb_with(list(needs), oracle) if oracle is not None else None
        QUERIES[name] = QuerySpec(name, fn, sql, tuple(needs), (fn.__doc__ or "").strip())
        return fn

    return deco


def canon_sql(name: str) -> str:
    """SQL twin of ``canonical_mappings`` for an already-canonical-named view."""
    return (
        "select upper(coalesce(source_table, '')) as source_table, upper(coalesce(source_field, '')) as source_field, "
        "upper(coalesce(dest_table, '')) as dest_table, upper(coalesce(dest_field, '')) as dest_field, "
        "coalesce(rules, '') as rules, coalesce(mapping_type, '') as mapping_type, "
        f"coalesce(object_name, '') as object_name, row_ord from {name}"
    )
