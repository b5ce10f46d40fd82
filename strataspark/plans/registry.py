"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataspark.plans import bodies, clouds_made, exports, geometry, lookup, prototype, spatial, vectors

MODULES = (vectors, spatial, geometry, lookup, exports, prototype, bodies, clouds_made)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
