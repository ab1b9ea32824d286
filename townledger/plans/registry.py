"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from townledger.plans import cases, dataflow, evaluation, labelling, pages, recorded, relational, retrieval, structural, textual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in (retrieval, relational, evaluation, textual, structural, dataflow, recorded, labelling, pages, cases):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
