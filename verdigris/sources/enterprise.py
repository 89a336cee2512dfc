"""A database server's fabric, read over JDBC: system tables, registry, and the base, add and delete tables of every versioned table."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.fabric import Fabric, FeatureTable
from verdigris.sources.catalog import VERSIONED_FLAG

# Marks of faults that a second try may mend, in the messages of drivers.
_TRANSIENT = re.compile(r"connection (?:reset|closed|refused|timed out)|socket|broken pipe|deadlock|communication link|terminating connection|too many clients|08\d{3}|40001|40P01", re.IGNORECASE)


def is_transient(error: BaseException) -> bool:
    """Whether a fault of a server may pass: lost connections, timeouts and deadlocks, none of syntax, rights or names."""
    return bool(_TRANSIENT.search(f"{type(error).__name__} {error}"))


def retried_once(read: Callable[[], DataFrame], wait_seconds: float = 0.2) -> DataFrame:
    """read(), and once more after a transient fault; other faults are passed on at once."""
    try:
        return read()
    except Exception as error:  # noqa: BLE001  drivers raise many kinds
        if not is_transient(error):
            raise
        time.sleep(wait_seconds)
        return read()


def lowered(rows: DataFrame) -> DataFrame:
    """The table with its names in lower case, as servers differ in theirs."""
    return rows.toDF(*[c.lower() for c in rows.columns])


def read_fabric(spark: SparkSession, config: dict, table: Callable[[SparkSession, dict, str], DataFrame], schema: str = "sde", only: list[str] | None = None) -> Fabric:
    """The fabric behind `table(spark, config, name)`; `only` names the tables to open, all versioned ones if not given.

    Nothing but the registry is read until a query asks; filters and columns of a query go to the server.
    """

    def read(name: str) -> DataFrame:
        return lowered(retried_once(lambda: table(spark, config, name)))

    registry = read(f"{schema}.sde_table_registry").filter((F.col("object_flags").bitwiseAND(VERSIONED_FLAG)) > 0)
    wanted = {n.lower() for n in only} if only is not None else None
    tables = {}
    for row in registry.select("registration_id", "owner", "table_name").collect():
        if wanted is not None and row.table_name.lower() not in wanted:
            continue
        base, number = f"{row.owner}.{row.table_name}", int(row.registration_id)
        tables[row.table_name.lower()] = FeatureTable(row.table_name.lower(), read(base), read(f"{row.owner}.a{number}"), read(f"{row.owner}.d{number}"), number)
    system = [read(f"{schema}.sde_{n}") for n in ("states", "state_lineages", "versions", "state_locks")]
    return Fabric(*system, tables)
