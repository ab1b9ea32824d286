"""Labels as JSON lines, plain or compressed: read with a schema, written in the order of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines (also .gz); a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def export_labels(labels: DataFrame, path: str, *keys: str, compression: str = "none") -> None:
    """Write labels as JSON lines in ascending key order, nulls kept."""
    labels.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("ignoreNullFields", "false").option("compression", compression).json(path)
