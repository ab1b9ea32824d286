"""Running sums over ordered groups of any size: a two-pass scan over sorted parts, so that no group is one task's."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the columns that are added on the way; a table may not have them.
PART = "_scan_part"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a session in one process, as in tests, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="townledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tl-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table in a shared folder: what is read again does not depend on how often its plan runs."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """df with PART: parts of about equal size whose numbers rise with (group, order). Equal keys share a part."""
    keys = [*(F.col(c) for c in group), *(F.col(c) if isinstance(c, str) else c for c in order)]
    dealt = df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id())
    return written(dealt, shared_folder(df.sparkSession))


def _equal(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    same = a[PART] == b[PART]
    for c in columns:
        same = same & a[c].eqNullSafe(b[c])
    return same


def sums_of_parts(dealt: DataFrame, group: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column]) -> DataFrame:
    """dealt, a table with parts, and for each name of sums the running sum of its column."""
    own = {f"_scan_{i}": (n, c) for i, (n, c) in enumerate(sums.items())}
    columns = dealt.columns
    dealt = dealt.select("*", *(c.alias(k) for k, (_, c) in own.items()))
    totals = dealt.groupBy(*group, PART).agg(*(F.sum(k).alias(k) for k in own))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    started = totals.select(*group, PART, F.count(F.lit(1)).over(before).alias("_scan_earlier"), *(F.sum(k).over(before).alias(f"{k}_before") for k in own))
    carried = started.filter("_scan_earlier > 0").drop("_scan_earlier")
    inside = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *(F.sum(k).over(inside).alias(f"{k}_here") for k in own))
    joined = summed.join(F.broadcast(carried), _equal(summed, carried, group), "left")
    total = lambda k: F.when(F.col(f"{k}_here").isNull(), F.col(f"{k}_before")).otherwise(F.col(f"{k}_here") + F.coalesce(F.col(f"{k}_before"), F.lit(0)))
    return joined.select(*(summed[c] for c in columns), *(total(k).alias(n) for k, (n, _) in own.items()))


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column]) -> DataFrame:
    """df with, for each name of sums, the sum of its column over the row and all before it in its group.

    A first pass deals the rows by range of (group, order) into parts and adds up each group's part; what came before a
    part's first group is a row a part at most, which is broadcast; inside its part a group is summed by a window.
    order must tell the rows of a group apart, or equal ones are numbered in any order. Nulls are a group of their
    own, null values add nothing (a sum without any value is null), and an empty table stays empty.
    """
    return sums_of_parts(parts(df, group, order), group, order, sums).drop(PART)


def previous_in_parts(dealt: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """dealt, a table with parts by ascending columns, and name: value in the row before it in its group, across parts too; null in a group's first row."""
    columns = dealt.columns
    ends = dealt.groupBy(*group, PART).agg(F.max(F.struct(*order, F.col(value).alias("_scan_last"))).alias("_scan_end"))
    before = Window.partitionBy(*group).orderBy(PART)
    carried = ends.select(*group, PART, F.lag("_scan_end").over(before)["_scan_last"].alias("_scan_value"), F.row_number().over(before).alias("_scan_n")).filter("_scan_n > 1").drop("_scan_n")
    inside = Window.partitionBy(PART, *group).orderBy(*order)
    here = dealt.select("*", F.lag(value).over(inside).alias("_scan_lag"), F.row_number().over(inside).alias("_scan_nth"))
    joined = here.join(F.broadcast(carried), _equal(here, carried, group), "left")  # a row a part at most
    return joined.select(*(here[c] for c in columns), F.when(F.col("_scan_nth") == 1, F.col("_scan_value")).otherwise(F.col("_scan_lag")).alias(name))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """df with name: 1, 2, 3, ... in each group by order."""
    return running_sums(df, group, order, {name: F.lit(1).cast("long")})
