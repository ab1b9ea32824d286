"""Predicted facts against labelled cases: which cases each sample of predictions gets right, accuracy and rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townledger.operators.metrics import run_summary
from townledger.operators.records import same_record

SAMPLES = 5
#: What a case and a prediction have in common.
KEYS = ("document_id", "kind", "unit")


def right_cases(cases: DataFrame, found: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The rows of cases, once for each sample 0, 1, ... in which some prediction is right, with that sample.

    cases: document_id, kind, unit, start, end, gold. found: sample, document_id, kind, unit, start, end, record and
    error (null if the fact was borne out). A prediction is right if it was accepted, has the case's document, kind and
    unit, overlaps its passage, and its record is the gold one (see same_record). A semi-join ends at the first such
    prediction, so a unit with many of them makes no pairs. Null keys or places match nothing; equal cases each count.
    """
    # Both sides move by these keys, cases before they are repeated for each sample; a join may use such partitions for more keys.
    cases.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    asked = cases.repartition(*KEYS).withColumn("sample", F.explode(F.array(*map(F.lit, range(samples))))).alias("c")
    given = found.filter(F.col("error").isNull()).alias("f")
    on = F.lit(True)
    for key in (*KEYS, "sample"):
        on = on & (F.col(f"c.{key}") == F.col(f"f.{key}"))
    overlap = (F.col("f.start") < F.col("c.end")) & (F.col("f.end") > F.col("c.start"))
    return asked.join(given, on & overlap & same_record(F.col("c.kind"), F.col("c.gold"), F.col("f.record")), "left_semi")


def extraction_accuracy(cases: DataFrame, found: DataFrame, by: Sequence[str] = ("kind", "city"), samples: int = SAMPLES) -> DataFrame:
    """(level, name, cases, runs, least, median, most): accuracy over all cases ("overall") and for each value of each column of by.

    A sample's accuracy is its share of right cases; the samples are summed up as runs. Samples without predictions
    count as wrong. A null value is a name of its own; without cases there are no rows.
    """
    names = [F.col(c) for c in by]
    asked = cases.select(*names, F.explode(F.array(*map(F.lit, range(samples)))).alias("sample"), F.lit(1).alias("n"), F.lit(0).alias("good"))
    good = right_cases(cases, found, samples).select(*names, "sample", F.lit(0).alias("n"), F.lit(1).alias("good"))
    # First added up by all columns, so that the levels are made from few rows.
    small = asked.unionByName(good).groupBy(*by, "sample").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    levels = [F.struct(F.lit("overall").alias("level"), F.lit("all").alias("name")), *(F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in by)]
    each = small.select(F.explode(F.array(*levels)).alias("l"), "sample", "n", "good").groupBy("l.level", "l.name", "sample").agg(F.sum("n").alias("cases"), (F.sum("good") / F.sum("n")).alias("accuracy"))
    return each.groupBy("level", "name").agg(F.max("cases").alias("cases"), *run_summary(F.col("accuracy")))


def reject_rate(found: DataFrame, *by: str) -> DataFrame:
    """(by, produced, rejected, rate): the share of facts that were not borne out; 0 where none was produced."""
    out = found.groupBy(*by).agg(F.count(F.lit(1)).alias("produced"), F.count("error").alias("rejected"))
    return out.withColumn("rate", F.coalesce(F.try_divide("rejected", "produced"), F.lit(0.0)))
