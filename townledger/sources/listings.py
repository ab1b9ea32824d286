"""Listings of meetings and documents: manifests, event feeds and HTML tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townledger.functions.text import html_text

MEETING = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "city_id", "body", "meeting_date", "recording_url", "recording_seek", "title", "source_key")])
DOCUMENT = T.StructType([*[T.StructField(n, T.StringType()) for n in ("id", "meeting_id", "city_id", "kind", "media_type", "file", "sha256")], T.StructField("bytes", T.LongType()), T.StructField("units", T.IntegerType())])
MANIFEST = T.StructType([T.StructField("meetings", T.ArrayType(MEETING)), T.StructField("documents", T.ArrayType(DOCUMENT))])


def manifest(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, city: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(meetings, documents) of a JSON manifest; dates are inclusive."""
    whole = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    meetings = whole.select(F.inline("meetings")).withColumn("meeting_date", F.to_date("meeting_date"))
    for c in (F.col("meeting_date") >= F.lit(first) if first else None, F.col("meeting_date") <= F.lit(last) if last else None, F.col("city_id") == city if city else None):
        meetings = meetings if c is None else meetings.filter(c)
    documents = whole.select(F.inline("documents"))
    return meetings, documents.join(meetings.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi")


def table_rows(pages: DataFrame, key: str, html: str, tag: str = "tr") -> DataFrame:
    """(key, row, cell_html): the elements of one tag of each page, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("row", "cell_html"))


def meetings_of(rows: DataFrame, html: str = "cell_html") -> DataFrame:
    """Meetings of table rows: clip, meeting_date and name; rows without a date or that are cancelled go, the first row of a clip stays."""
    text = html_text(F.col(html))
    day = F.regexp_extract(text, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", 1)
    made = rows.withColumns({"clip": F.regexp_extract(html, r"clip_id=(\d+)", 1), "meeting_date": F.try_to_date(day, "MMMM d, yyyy"), "name": text})
    made = made.filter(F.col("meeting_date").isNotNull() & ~F.lower("name").contains("cancel") & (F.col("clip") != ""))
    return made.withColumn("_n", F.row_number().over(Window.partitionBy("clip").orderBy("row"))).filter("_n = 1").drop("_n")


def file_kind(magic: Column) -> Column:
    """pdf, vtt or srt by the first bytes of a file; null for all else."""
    head = magic.cast("string")
    return F.when(head.startswith("%PDF"), "pdf").when(head.startswith("WEBVTT"), "vtt").when(head.rlike(r"^\s*\d+\s*\n\d{1,2}:"), "srt")
