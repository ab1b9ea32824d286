"""Tables of documents' rows that are replaced document by document: hashed buckets, copied on write, with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Columns of a table's files and of its manifest; rows may not have them.
BUCKET, GENERATION = "_bucket", "_generation"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def _manifest(spark: SparkSession, path: str) -> tuple[int, int, dict[int, int]]:
    """(version, number of buckets, generation of each bucket that has rows) of the latest version; version 0 before the first.

    A manifest has a row a bucket, whatever the number of documents.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(where)] if files.exists(where) else []
    done = [int(p.getName().removeprefix("v")) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        return 0, 0, {}
    rows = spark.read.schema(f"buckets int, {BUCKET} int, {GENERATION} int").parquet(f"{path}/manifest/v{max(done)}").collect()
    return max(done), rows[0]["buckets"], {r[BUCKET]: r[GENERATION] for r in rows if r[BUCKET] is not None}


def _read(spark: SparkSession, path: str, schema: StructType, places: dict[int, int]) -> DataFrame:
    folders = [f"{path}/data/generation{g}/{BUCKET}={b}" for b, g in sorted(places.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a table's latest version; none before the first."""
    return _read(spark, path, schema, _manifest(spark, path)[2])


def replace_rows(df: DataFrame, path: str, key: str = "document_id", gone: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Put df into the table at path in place of all rows of its documents, and take the documents of gone (key) out; the new version's number.

    Only the buckets of these documents are read and written anew, into a generation of their own; the others' files
    stay. A version counts once its manifest is whole, so a job that is stopped on the way changes nothing, and readers
    keep the version that they began with. A bucket goes to as many tasks as its size asks for, so one with a hot
    document is split. A table has one writer at a time; a version that was left half made is made anew.
    The number of buckets is fixed by the first version. A null key is a document of its own, equal rows all stay,
    a document without rows in df or gone is untouched, and an empty df without gone makes a version like the last.
    """
    spark, schema = df.sparkSession, df.schema
    if {BUCKET, GENERATION} & set(df.columns):
        raise ValueError(f"a table has no columns {BUCKET} and {GENERATION}")
    version, fixed, places = _manifest(spark, path)
    buckets, version = fixed or buckets, version + 1
    keys = df.select(key) if gone is None else df.select(key).unionByName(gone.select(key))
    touched = {r[0] for r in keys.select(_bucket(key, buckets)).distinct().collect()}  # a number a bucket at most
    old = _read(spark, path, schema, {b: g for b, g in places.items() if b in touched})
    replaced = keys.select(F.col(key).alias("_replaced")).distinct()
    kept = old.join(replaced, F.col(key).eqNullSafe(F.col("_replaced")), "left_anti")
    new = kept.unionByName(df).withColumn(BUCKET, _bucket(key, buckets))
    folder = f"{path}/data/generation{version}"
    new.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    held = {r[0] for r in spark.read.schema(StructType([*schema.fields]).add(BUCKET, "integer")).parquet(folder).select(BUCKET).distinct().collect()}
    rows = [(buckets, b, g) for b, g in places.items() if b not in touched] + [(buckets, b, version) for b in held]
    manifest = spark.createDataFrame(rows or [(buckets, None, None)], f"buckets int, {BUCKET} int, {GENERATION} int")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")
    return version
