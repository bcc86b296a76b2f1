"""Every query of the engine's own operators, and the same in DuckDB's SQL.

The operators of the result-book model run here on stand-in columns of the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rinkframe.functions import geometry, naming
from rinkframe.operators import books, detect, labels, pixels, raster, records, scores, sequences, sets, slots, tensor
from rinkframe.plans import book
from rinkframe.sources import bundles, store, training
from rinkframe.streaming import pages as page_stream, queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (sequences, sets, records, books, scores, slots, labels, pixels, raster, detect, tensor, geometry, naming, book, bundles, store, training, queue, page_stream):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["possession_keep"](spark, sf_dir)
