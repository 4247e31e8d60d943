"""Every query of the library by name, with its equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import custody, graphs, metrics, models, topology

PARTS = (graphs, topology, metrics, custody, models)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: x for part in PARTS for k, x in part.ORACLE_SQL.items()}
FLAGSHIP = "triangle_census"
