"""Caption files: SRT and WebVTT as rows of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.functions import text as T

# A time of day as both formats write it, and what both put between two of them.
TIME = r"\d{1,2}:\d{2}:\d{2}[,.]\d{3}"
TIMING = rf"[ \t]*({TIME})[ \t]*-->[ \t]*({TIME})[^\n]*"
#: A line with something in it that is no timing, nor the number of a cue before its timing.
_TEXT = rf"(?:(?![^\n]*-->)(?![ \t]*\d+[ \t]*\n{TIMING})[^\n]*\S[^\n]*(?:\n|\z))"
_VTT_TEXT = r"(?:(?![^\n]*-->)[^\n]*\S[^\n]*(?:\n|\z))"
#: A note or a style sheet: all up to the next blank line.
_ASIDE = r"(?m)^[ \t]*(?:NOTE|STYLE)(?:[ \t][^\n]*)?(?:\n|\z)(?:[^\n]*\S[^\n]*(?:\n|\z))*"


def cues(files: DataFrame, key: str = "path", body: str = "value", vtt: bool | None = None, empty: str = "fail") -> DataFrame:
    """(key, cue, start_ms, end_ms, text) of files given as rows of whole texts; by default a file that begins with WEBVTT is one.

    A cue is a timing and the lines below it up to a blank one; broken timings, notes and styles are passed over, tags
    dropped, character references decoded. A file without cues fails the job, unless empty is "pass". A null body is empty.
    """
    lines = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"\r\n?", "\n")
    is_vtt = F.ltrim(F.regexp_replace(F.substring(lines, 1, 64), "﻿", "")).startswith("WEBVTT") if vtt is None else F.lit(vtt)
    found = lambda text, k: F.regexp_extract_all(F.col("_lines"), F.lit(rf"(?m)^{TIMING}(?:\n|\z)({text}*)"), F.lit(k))
    part = lambda k: F.when(F.col("_vtt"), found(_VTT_TEXT, k)).otherwise(found(_TEXT, k))
    rows = files.select(key, is_vtt.alias("_vtt"), F.when(is_vtt, F.regexp_replace(lines, _ASIDE, "")).otherwise(lines).alias("_lines"))
    rows = rows.select(key, F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("t"))).alias("_at", "c"))
    plain = T.squeeze(T.normalize(F.regexp_replace(T.unescape(F.regexp_replace("c.t", r"\s*\n\s*", " ")), "<[^>]+>", "")))
    rows = rows.select(key, "_at", T.time_ms(F.col("c.a")).alias("start_ms"), T.time_ms(F.col("c.b")).alias("end_ms"), plain.alias("text")).filter("text != ''")
    one = F.struct("_at", "start_ms", "end_ms", "text")
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("cues"))
    if empty == "fail":
        none = F.raise_error(F.concat(F.lit("no cues in "), F.col(key).cast("string")))
        held = files.select(key).join(held, key, "left").withColumn("cues", F.when(F.size("cues") > 0, F.col("cues")).otherwise(none.cast(held.schema["cues"].dataType)))
    return held.select(key, F.posexplode("cues").alias("cue", "c")).select(key, "cue", "c.start_ms", "c.end_ms", "c.text")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return cues(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))
