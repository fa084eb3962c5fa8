"""Names of the queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattice.plans import files, queries
from lattice.plans.files import FILE_SQL
from lattice.plans.oracle import ORACLE_SQL as ARRAY_SQL

__all__ = ["BRUTE_FORCE", "ORACLE_SQL", "QUERIES"]

ORACLE_SQL = {**ARRAY_SQL, **FILE_SQL}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(files if name in FILE_SQL else queries, name) for name in ORACLE_SQL}

#: Queries whose number of rounds only the data tells; brute force in the tests holds them, not SQL.
BRUTE_FORCE: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(queries, name) for name in ("kmeans_fit", "kmeans_delta")}
